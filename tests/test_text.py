from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import grams as G
from quillspark.functions import text as X
from quillspark.functions.profiles import GURMUKHI
from quillspark.operators import rows as W


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "bones"), [("ਗੁਰੂ ॥੧॥", "ਗਰ"), ("ਸ਼ਾਮ", "ਸਮ"), ("ਸੰਤ", "ਸਤ"), ("", ""), (None, "")])
def test_skeleton(spark, text, bones):
    assert one(spark, text, lambda T: X.skeleton(T, GURMUKHI)) == bones


def test_tokens(spark):
    assert one(spark, ">> ਤੇਰੀ >> ਸਰਣਿ", lambda T: X.tokenize(T)) == ["ਤੇਰੀ", "ਸਰਣਿ"]
    assert one(spark, "ਜੀਉ॥", lambda T: X.clean_token(T)) == "ਜੀਉ"
    assert one(spark, None, lambda T: X.tokenize(T)) == []


@pytest.mark.parametrize(("text", "clean"), [("ਜਾਲunk> ਮੁਕਤੇ", "ਜਾਲ ਮੁਕਤੇ"), ("ਕਢਾਇ<un ਸੀਰਾਗ", "ਕਢਾਇ ਸੀਰਾਗ"), ("ਸਾਲਾਹਿਹਿ<k ਸਭੇ", "ਸਾਲਾਹਿਹਿ ਸਭੇ")])
def test_unknown_artifacts(spark, text, clean):
    assert one(spark, text, lambda T: X.strip_unknown(T)) == clean


@pytest.mark.parametrize(("text", "seconds", "drop"), [("ਤੇਰੀ ਸਰਣਿ", 0.5, True), ("ਜ", 2.0, True), (">> >> 123", 2.0, True), ("ਤੇਰੀ ਸਰਣਿ ਮੇਰੇ ਦੀਨ ਦਇਆਲਾ", 2.5, False), ("ਤੇਰੀ ਸਰਣਿ", None, True)])
def test_drop_candidate(spark, text, seconds, drop):
    row = spark.createDataFrame([(text, seconds)], "t string, d double")
    assert row.select(W.drop_candidate(F.col("d"), F.col("t"), GURMUKHI)).first()[0] is drop


@pytest.mark.parametrize("token", ["ਵਾਹੇਗੁਰੂ", "ਵਾਹਿਗੁਰੁ", "ਵਾਹਿਗੁਰ", "ਵਹਿਗੁਰੂ"])
def test_chant_spellings(spark, token):
    assert one(spark, token, lambda T: X.normalize_chant(X.tokenize(T), GURMUKHI)) == ["ਵਾਹਿਗੁਰੂ"]


@pytest.mark.parametrize(("text", "chant"), [("ਵਾਹਿਗੁਰੂ " * 8, True), ("ਵਾਹਿਗੁਰੂ " * 4, False), ("ਵਾਹਿਗੁਰੂ ਹਰਿ " * 6, False), ("ਵਾਹਿਗੁਰੂ " * 6 + "ਹਰਿ " * 4, False), ("ਵਾਹਿਗੁਰੂ " * 7 + "ਹਰਿ " * 3, True)])
def test_chant_detection(spark, text, chant):
    assert one(spark, text, lambda T: W.is_chant(X.tokenize(T), GURMUKHI)) is chant


def test_headers(spark):
    assert one(spark, "ਸੀ ਰਾਗ ਮਹਲਾ ਪੰ", lambda T: X.normalize_header(T, GURMUKHI)) == "ਸ੍ਰੀਰਾਗੁ ਮਹਲਾ ੫"
    assert len(one(spark, "ਹਰਿ ਹਰਿ ਨਾਮ ਸੀਰਾਗ ਮਹਲਾ ੧ ਸਚੁ", lambda T: X.split_at_headers(T, GURMUKHI))) == 2
    assert len(one(spark, "ਸੀਰਾਗ ਮਹਲਾ ੧ ਸਚੁ", lambda T: X.split_at_headers(T, GURMUKHI))) == 1


@pytest.mark.parametrize(("a", "b", "cap", "out"), [("a b c d", "c d e f", 2, "a b c d e f"), ("a b c d", "c d e f", 1, "a b c d c d e f"), ("x y z", "p q a b", 12, "x y z p q a b"), ("", "a b", 12, "a b"), ("a b", "", 12, "a b"), ("a b", "a b", 12, "a b")])
def test_seam_merge(spark, a, b, cap, out):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert " ".join(row.select(X.seam_merge(X.tokenize(F.col("a")), X.tokenize(F.col("b")), cap).alias("x")).first()["x"]) == out


def test_runs_and_dominant(spark):
    assert one(spark, "a a b b b c", lambda T: X.longest_run(X.tokenize(T))) == 3
    assert one(spark, "", lambda T: X.longest_run(X.tokenize(T))) == 0
    assert one(spark, "b a a b", lambda T: X.dominant_token(X.tokenize(T)))["token"] == "b"
    assert one(spark, "la la la la", lambda T: X.suppress_single_token(T)) == ""


def test_scalars(spark):
    assert one(spark, "12.3 MB", lambda T: X.parse_size(T)) == 12_300_000
    assert one(spark, "none", lambda T: X.parse_size(T)) == 0
    assert one(spark, "https://x.org/w?v=1&t=42s", lambda T: X.url_offset(T)) == 42
    assert one(spark, "https://x.org/w", lambda T: X.url_offset(T)) is None
    assert one(spark, "one two " * 40, lambda T: X.tail(T, 20)).startswith(("one", "two"))
    assert one(spark, "é", lambda T: X.nfc(T)) == "é"
    assert one(spark, "a_b_c_d_e.mp3", lambda T: X.filename_fields(T)) == ["a", "b", "c", "d", "e"]
    assert one(spark, "a_b.mp3", lambda T: X.filename_fields(T)) is None


def test_grams(spark):
    assert one(spark, "abcde", lambda T: G.char_grams(T)) == ["abcd", "bcde"]
    assert one(spark, "ab", lambda T: G.char_grams(T)) == ["ab"]
    assert one(spark, "", lambda T: G.char_grams(T)) == []
    row = spark.createDataFrame([("abcd", "abxy")], "a string, b string")
    assert row.select(G.common_prefix(F.col("a"), F.col("b"))).first()[0] == 2
    assert row.select(G.overlap_coefficient(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("x")).first()["x"] == 1.0


def test_caption_and_verse_marks(spark):
    rows = [("(ਰਾਮ) ਨਾਮੁ । (Music) [x] ॥੧॥ ( sangit ) ਹਰਿ\u200c",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(X.strip_caption(F.col("t")), X.strip_verse_marks(F.col("t")), X.strip_verse_marks(F.col("t"), " ")).collect()]
    kept = "(ਰਾਮ) ਨਾਮੁ । (Music) [x] ( sangit ) ਹਰਿ\u200c"
    assert got == [("(ਰਾਮ) ਨਾਮੁ ਹਰਿ", kept, kept), (None, None, None), ("", "", "")]


def test_sources(spark, tmp_path):
    from quillspark.sources import parsers as R

    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\n')
    assert sorted(map(tuple, R.jsonl_directory(spark, str(tmp_path), "id long").collect())) == [(1, "a"), (2, "a"), (3, "b")]
    (tmp_path / "c.json").write_text('[{"id": 1, "t": "x"}, {"id": 2}]')
    assert sorted(map(tuple, R.json_array(spark, str(tmp_path / "c.json"), "id long, t string").collect())) == [(1, "x"), (2, None)]
    (tmp_path / "d.csv").write_text('id,t\n1,"a ""b""\nc"\n2,\n')
    assert sorted(map(tuple, R.csv_rows(spark, str(tmp_path / "d.csv"), "id long, t string").collect())) == [(1, 'a "b"\nc'), (2, None)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "manifest.jsonl").write_text('{"id": 1}\nbroken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.manifest_tree(spark, str(tmp_path), "id long").collect()
    asked, answered = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long"), spark.createDataFrame([(1, "ok")], "id long, verdict string")
    assert sorted(map(tuple, R.missing_ids(asked, answered, "id", verdict=F.lit("REJECT")).collect())) == [(1, "ok"), (2, "REJECT"), (3, "REJECT")]
    df = spark.createDataFrame([("&amp;&eacute;&#x41;",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(R.html_unescape(F.col("t"))).collect()] == ["&éA", "a", None]


def test_dominant_token_is_counted_in_one_pass(spark):
    long = " ".join(f"w{k % 30000}" for k in range(60_001))
    found = one(spark, long, lambda T: X.dominant_token(X.tokenize(T)))  # by pairs: 1.8 billion comparisons
    assert (found["token"], found["n"]) == ("w0", 3)
    assert one(spark, "b a c a b", lambda T: X.dominant_token(X.tokenize(T)))["token"] == "b"
    assert one(spark, "", lambda T: X.dominant_token(X.tokenize(T))) is None


def test_suspect_windows_sort_no_texts(spark):
    rows = spark.createDataFrame([("s", k, "a " * n) for k, n in enumerate([9, 9, 9, 30, 2, 30, 12, 9, 9, 9])], "s string, ord int, t string")
    found = W.suspect_flag(rows, "s", "i", X.tokenize(F.col("t")), F.lit(False), repeats=12, order="ord").select("ord", "flag")
    assert [r.flag for r in found.orderBy("ord").collect()] == ["intro"] * 3 + ["repeat", "short", "repeat", "repeat"] + ["outro"] * 3
    found = W.suspect_flag(rows, "s", "i", X.tokenize(F.col("t")), F.lit(False), repeats=99, order="ord").select("ord", "flag")
    assert [r.flag for r in found.orderBy("ord").collect()][3:7] == ["none", "short", "none", "none"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.rindex("Window")]  # tokens are made below all windows


def test_clean_text_binds_its_tokens_once(spark):
    texts = ["Th <unk> thé  x1y\tthe\nTHE!", "", None, "12 34", "ß th<un k> àth", "  the", "aeiou th e t-h"]
    for text in texts:
        kept = X.collapse(F.regexp_replace(X.strip_unknown(F.col("t")), r"[^A-Za-zÀ-ÖØ-öø-ÿ\s]", " "))
        before = X.tokenize(kept)
        expected = spark.createDataFrame([(text,)], "t string").select(F.array_join(X.normalize_chant(before), " ").alias("a"), before.alias("b"), X.normalize_chant(before).alias("c")).first()
        found = one(spark, text, lambda T: X.clean_text(T))
        assert (found["text"], found["changed"]) == (expected["a"], sum(x != y for x, y in zip(expected["b"], expected["c"], strict=True))), text
    plan = spark.createDataFrame([("x",)], "t string").select(X.clean_text(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("un>|") == 1  # the artefacts are stripped once


def test_shares_met_by_place():
    import random

    from quillspark.operators import validate as V

    def meets(a, b):
        if not a or not b:
            return False, False
        if a == b:
            return True, False
        if a in b or b in a:
            return True, True
        return len(a) == len(b) >= 2 and sum(x != y for x, y in zip(a, b, strict=True)) <= 1, False

    r = random.Random(1)
    for _ in range(400):
        mine, theirs = ([("".join(r.choices("ab", k=r.randrange(5)))) for _ in range(r.randrange(9))] for _ in range(2))
        at = hits = 0
        for bones in mine:
            j, part = next(((j, p) for j in range(at, len(theirs)) for ok, p in (meets(bones, theirs[j]),) if ok), (None, False)) if bones else (None, False)
            hits += not bones or j is not None
            at = at if j is None else j if part else j + 1
        assert V._met(mine, theirs) == hits
