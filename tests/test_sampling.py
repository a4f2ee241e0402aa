from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sampling as S
from quillspark.operators import segments as E


@pytest.mark.parametrize(("sizes", "target", "kept"), [({"A": 50, "B": 50, "C": 50}, 100, 30), ({"A": 200}, 750, 10), ({f"s{i}": 20 for i in range(100)}, 750, 750), ({f"s{i}": 20 for i in range(100)}, 100, 100)])
def test_chant_quota(spark, sizes, target, kept):
    rows = [(f"{k}_{i}", k, True) for k, n in sizes.items() for i in range(n)] + [("plain", "A", False), ("none", "A", None)]
    out = S.chant_quota(spark.createDataFrame(rows, "id string, s string, c boolean"), "c", "s", "id", target=target)
    assert out.filter("c").count() == kept and out.filter("c is null or not c").count() == 2
    if target == 100 and len(sizes) == 100:
        assert out.filter("c").select("s").distinct().count() == 100


def test_budget_takes_the_crossing_row(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(9)] + [(99, 0.0)], "i int, q double")
    assert sorted(r.i for r in S.budget_prefix(df, ["i"], "q", 25.0).collect()) == [0, 1, 2]


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "i long, g long")
    out = S.group_disjoint_split(df, "g", "i", {"val": 15, "test": 12})
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n["val"] == 15 and n["test"] == 12 and out.count() == 100
    groups = out.filter("split in ('val', 'test')").groupBy("g").agg(F.countDistinct("split").alias("k"))
    assert groups.filter("k > 1").count() == 0
    assert S.offset_split(df, ["i"], 10, 5).filter("split = 'val'").count() == 5


def test_oversample(spark):
    df = spark.createDataFrame([(i, i < 10) for i in range(50)], "i long, m boolean")
    assert S.oversample(df, F.col("m"), 0.6, "i").filter("m").count() == 60


def test_sidecar_merge(spark):
    from quillspark.sources import sinks

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "clip_id string, text string")
    side = spark.createDataFrame([("b", "z", True)], "clip_id string, final string, ok boolean")
    out = {r.clip_id: r for r in sinks.merge_sidecar(rows, side, "clip_id", ["final", "ok"]).collect()}
    assert out["a"].final is None and out["b"].final == "z" and out["b"].ok


def test_append_new(spark, tmp_path):
    from quillspark.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "s string, x int")
    path = str(tmp_path / "t")
    assert sinks.append_new(rows.filter("s = 'a'"), path, "s").count() == 1
    sinks.append_new(rows, path, "s")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2]


def test_overlap_dedup_and_windows(spark):
    words = spark.createDataFrame([("s", 0.0, 1.0, "a"), ("s", 0.5, 1.2, "b"), ("s", 0.95, 2.0, "c")], "k string, b double, e double, w string")
    assert [r.w for r in E.overlap_dedup(words, "k", "b", "e").orderBy("b").collect()] == ["a", "c"]
    sessions = spark.createDataFrame([("s", 45.0), ("t", 42.0), ("z", 0.0)], "k string, n double")
    assert E.tail_windows(sessions, "n", 20.0, 5.0).groupBy("k").count().orderBy("k").collect()[0]["count"] == 3


def test_parsers(spark):
    from quillspark.sources import parsers

    text = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\n<b>Hi</b> &amp; you\n\nNOTE x\n"
    df = spark.createDataFrame([(1, text)], "i int, c string")
    r = parsers.vtt_cues(df, "c", "i").collect()
    assert [(x.start_s, x.end_s, x.text) for x in r] == [(1.0, 2.5, "Hi & you")]
    js = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":"\\nb","tOffsetMs":200}]},{"tStartMs":2000}]}'
    df = spark.createDataFrame([(1, js)], "i int, c string")
    assert [(x.start_s, x.text) for x in parsers.json3_cues(df, "c").collect()] == [(1.0, "a b")]
    assert [x.word for x in parsers.json3_words(df, "c").collect()] == ["a", "b"]
    line = '{"custom_id":"w_0","response":{"body":{"choices":[{"message":{"content":"{\\"results\\":[{\\"id\\":\\"c1\\",\\"text\\":\\"t\\",\\"verdict\\":\\"APPROVE\\"}]}"}}]}}}'
    good, bad = parsers.batch_outputs(spark.createDataFrame([(line,), ('{"custom_id":"w_1","error":"x"}',)], "l string"), "l")
    assert good.count() == 1 and bad.count() == 1


def test_walk_listings(spark):
    from quillspark.sources import parsers

    rows = [("root", '<a href="?dir=a">a</a> <a href="?dir=b%20c">b</a>'), ("a", '<a href="?dir=root">up</a><a href="x.mp3">x</a> <span>1.5 MB</span>'), ("b c", ""), ("other", '<a href="?dir=a">a</a>')]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert {(r.url, r.depth) for r in parsers.walk_listings(pages, "url", "html", "root").collect()} == {("root", 0), ("a", 1), ("b c", 1)}
    files = parsers.directory_listing(pages.filter("url = 'a'"), "html", "url").collect()
    assert [(f.name, f.href, f.size_bytes) for f in files] == [("x", "x.mp3", 1_500_000)]


def test_walk_listings_follows_long_chains(spark):
    from quillspark.sources import parsers

    pages = spark.createDataFrame([(f"p{i}", f'<a href="?dir=p{i + 1}">next</a><a href="?dir=p0">top</a>') for i in range(55)], "url string, html string")
    found = {(r.url, r.depth) for r in parsers.walk_listings(pages, "url", "html", "p0").collect()}
    assert found == {(f"p{i}", i) for i in range(56)}


def test_stage2_merge(spark):
    from quillspark.operators import stages

    rows = spark.createDataFrame([(1, "review", 7, "teri saran"), (2, "matched", 7, "teri"), (3, "unchanged", None, "x"), (4, "review", 7, "teri saran")], "clip_id long, decision string, work_id long, final_text string")
    corrector = spark.createDataFrame([(1, "teri sarani"), (4, "completely different words here now")], "clip_id long, corrected string")
    reviewer = spark.createDataFrame([(1, "approve", None)], "clip_id long, verdict string, improved string")
    words = spark.createDataFrame([(7, ["teri", "sarani"])], "work_id long, words array<string>")
    out = {r.clip_id: (r.decision2, r.final_text2, r.usable) for r in stages.review_stage(rows, corrector, reviewer, words).collect()}
    assert out[1] == ("replaced_llm", "teri sarani", True) and out[2] == ("matched", "teri", True)
    assert out[3] == ("unchanged", "x", False) and out[4] == ("validator_fallback", "teri saran", False)


def test_sessions_are_those_decided_clip_by_clip(monkeypatch):
    """Scores and alignments made beforehand, and few best works of each text, change nothing."""
    import random

    from quillspark.operators import align as A
    from quillspark.operators import stages

    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfgae") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    lines = [(w, n, 10 * w + n, t, "".join(map(A._python_skeleton("latin"), t))) for w in range(1, 13) for n in range(3) for t in [[rng.choice(words) for _ in range(5)]]]
    works = stages.Works(lines, "latin")
    said = [(rng.choice(lines)[3][: rng.randint(2, 5)] + [rng.choice(words)] * rng.randint(0, 3), rng.random() < 0.1) for _ in range(120)]
    bones = ["".join(map(A._python_skeleton("latin"), t)) for t, _ in said]
    at = lambda k: bones[k] if 0 <= k < len(bones) else ""
    rows = [{"tokens": t, "joined": " ".join(t), "clean": " ".join(t), "bones": bones[k], "before": at(k - 1), "before2": at(k - 2), "after": at(k + 1), "after2": at(k + 2), "x_work": 3 if x else None, "x_line": 30 if x else None} for k, (t, x) in enumerate(said)]
    following = {w: w % 12 + 1 for w in range(1, 13)}

    def plain(row, hits, next_works):
        def best(text):
            scores = next(works.scores([text]))[0]
            boost = {w: 0.8 * n / sum(hits.values()) for w, n in hits.items()}
            if next_works and hits:
                front = max(hits, key=lambda w: hits[w])  # the first of equals
                boost[front] = boost.get(front, 0.0) + 0.8
                boost[next_works[front]] = boost.get(next_works[front], 0.0) + 0.5
            for w, more in boost.items():
                scores[works.place[w]] *= 1 + more
            k = int(scores.argmax())
            top, scores[k] = float(scores[k]), -1.0
            return k, top, (top - max(float(scores.max()), 0.0)) / top if top > 0 else 0.0

        if row["x_work"] is not None:
            return "exact", row["x_work"], None
        k, score, margin = best(row["before"] + row["bones"] + row["after"])
        if margin < 0.05:
            k, score, margin = best(row["before2"] + row["before"] + row["bones"] + row["after"] + row["after2"])
        if score < 2.0:
            return "unchanged", works.ids[k] if score > 0 else None, margin
        return A.decide(*A.align_with_orphans(row["tokens"], works.references[k]), "latin"), works.ids[k], margin

    for best, next_works in ((2, None), (2, following), (8, None), (50, following)):
        monkeypatch.setattr(stages, "BEST", best)
        hits, expected = {}, []
        for row in rows:
            expected.append(plain(row, hits, next_works))
            if expected[-1][0] in stages.WITNESS:
                hits[expected[-1][1]] = hits.get(expected[-1][1], 0) + 1
        assert len({e[1] for e in expected}) > 3
        fresh = [r | {"narrow": n, "wide": None, "known": {}} for r, n in zip(rows, works.best([r["before"] + r["bones"] + r["after"] for r in rows]), strict=True)]
        session = stages.Session(works, next_works, 0.8, 0.8, 0.5, 2.0, 0.05)
        found = [c for k in range(0, len(fresh), 50) for c in session.clips([[r] for r in fresh[k : k + 50]])]
        assert [(f["decision"], f["work"], f["margin"]) for f in found] == expected


def test_sessions_are_dealt_evenly(spark):
    """The largest sessions lie in tasks of their own, and every row of a session in one task."""
    from quillspark.operators import stages

    rows = spark.createDataFrame([(f"s{k}", n) for k in range(5) for n in range(40 - k)] + [(f"few{k}", 0) for k in range(9)] + [(None, 1)] * 3, "session string, n int")
    dealt = stages._by_session(rows, rows, 5).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.session or "", r.n) for r in dealt) == sorted((r.session or "", r.n) for r in rows.collect())
    parts = {}
    for r in dealt:
        parts.setdefault(r.session, set()).add(r.part)
    assert all(len(p) == 1 for p in parts.values())
    assert len(set.union(*(parts[f"s{k}"] for k in range(5)))) == 5


def test_values_are_those_of_lists():
    import pyarrow as pa

    from quillspark.operators import stages

    arrays = [pa.array([["a", None], None, [], ["b"]]), pa.array([[1, 2], None, [3]]), pa.array([["q"], ["r", "s"], None, ["t"]]).slice(1, 2), pa.array(["x", None]), pa.array([1, None, 2]), pa.array([True, False]), pa.array([1.5]), pa.array([], pa.list_(pa.string()))]
    for a in arrays:
        found, expected = stages._values(a), a.to_pylist()
        assert found == expected and list(map(type, found)) == list(map(type, expected))


def test_chants_are_those_counted_token_by_token(spark):
    from quillspark.functions import text as X
    from quillspark.functions.profiles import GURMUKHI, LATIN
    from quillspark.operators import rows as W

    texts = ["the " * 5, "the " * 4, "THE thé the, tha 'the' x", "the the x the the the", "the " * 5 + "x y z", "th1 " * 5, "", None, "ßth " * 6, "ਵਾਹਿਗੁਰੂ " * 5, "ਵਾਹਿਗੁਰੂ ਵਹਗਰ " * 3 + "ਸਤਿ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for profile in (LATIN, GURMUKHI):
        tokens = X.tokenize(F.col("t"))
        flags = X.chant_tokens(tokens, profile)
        n, total = F.size(F.filter(flags, lambda f: f)), X.script_tokens(tokens, profile)
        slow = (n >= 5) & (X.longest_true_run(flags) >= 5) & (total > 0) & (n >= F.lit(0.7) * total)
        both = df.select(W.is_chant(tokens, profile), slow).collect()
        assert [r[0] for r in both] == [r[1] for r in both] and any(r[0] for r in both)
        assert W.is_chant(F.col("t"), profile)._jc.toString().startswith("CASE WHEN")  # counted only where a run is found
