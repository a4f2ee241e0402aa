from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import similarity as M
from quillspark.operators import retrieval as R
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
LINES = [(1, 10 + i, t) for i, t in enumerate(["the old harbour wall was built of grey stone by the people of the town long before the war and it stands", "grey stone", "a b", "the people of the town", "rain fell on the hills all night", "the people of the town"])]
LINES += [(2, 20 + i, f"the town and the harbour have their year {i} of rain and of grey hills") for i in range(70)]
QUERIES = [(1, "grey stone"), (2, "stone harbour"), (3, "ab"), (4, "   "), (5, "qqq zzz"), (6, "the people of the town rain fell on the hills all night"), (7, "hills of grey rain " * 40), (8, "harbour wall stands"), (9, "hills of the town"), (10, "grey stone"), (11, None)]


def tables(spark):
    return spark.createDataFrame(QUERIES, "id long, text string"), spark.createDataFrame(LINES, "work long, line long, text string")


@pytest.mark.parametrize("block", [1000, 20])
def test_token_set_best_against_all_lines(spark, block):
    queries, lines = tables(spark)
    found = {r.query_id: (r.line_id, r.ratio) for r in R.token_set_best(queries, "id", "text", lines, "line", "text", block=block).collect()}
    expected = {}
    for i, q in QUERIES:
        best = max((M.token_set(q or "", t), -line) for _, line, t in LINES if len(t) >= 4)
        expected[i] = (-best[1], best[0]) if (q or "").split() else (None, 0.0)
    assert found == expected
    assert found[8][1] == 1.0  # wholly in a line more than three times as long


def test_sequence_best_takes_lines_and_pairs_apart(spark):
    queries, lines = tables(spark)
    found = {r.query_id: (r.line_id, r.ratio) for r in R.sequence_best(queries, "id", "text", lines, "work", "line", "text").collect()}
    assert found.keys() == dict(QUERIES).keys()
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    for i, q in QUERIES:
        if not q or len(q) < 3:
            assert found[i] == (None, 0.0)
            continue
        fits = lambda t, q=q: 0.3 * len(q) <= len(t) <= 3 * len(q)
        near = sorted((-len(grams(q) & grams(t)), line) for _, line, t in LINES if fits(t) and grams(q) & grams(t))
        firsts = {line for _, line in near[:50]}
        choices = [(t, 2 * line) for _, line, t in LINES if line in {x for _, x in near[:200]}]
        for (w, a, t), (v, b, u) in zip(LINES, LINES[1:], strict=False):
            if w == v and firsts & {a, b} and fits(f"{t} {u}"):
                choices.append((f"{t} {u}", 2 * a + 1))
        best = max(((SequenceMatcher(None, t, q, autojunk=False).ratio(), -n) for t, n in choices), default=(0.0, None))
        assert found[i] == (None if best[1] is None else -best[1], best[0]), q


def test_every_sentence_is_answered(spark):
    sentences = {r.id: r.text for r in catalogue.doc_lines(spark, SF).collect()}
    for name in ("token_set_classify", "fuzzy_sequence_match"):
        assert {r.query_id for r in catalogue.QUERIES[name](spark, SF).select("query_id").collect()} == sentences.keys()


def test_sentences_of_any_length_are_matched(spark):
    sentences = {r.id: r.text for r in catalogue.doc_lines(spark, SF).collect()}
    for name, key in (("trigram_candidate_match", "query_id"), ("nw_align_ops", "id")):
        found = {len(sentences[r[key]]) for r in catalogue.QUERIES[name](spark, SF).select(key).distinct().collect()}
        assert min(found) < 12 and max(found) > 200, name


def test_works_are_scored_where_texts_lie(spark, monkeypatch):
    works = [(k, f"{t} {'grey stone ' * (k % 4)}") for k, (_, _, t) in enumerate(LINES)] + [(900, "héé ß 🙂🙂 x"), (901, "héé ß 🙂🙂 x"), (902, "ab")]
    lines = spark.createDataFrame(works, "work long, text string")
    texts = [*QUERIES, (12, "stone harbour"), (12, "grey"), (13, "🙂🙂 x und ß"), (14, "ab"), (15, "abc"), (None, "the people"), (None, "of the town")]
    queries = spark.createDataFrame(texts, "id long, text string")
    index = R.gram_index(lines, "work", F.col("text"))
    expected = sorted(map(tuple, R.top_with_margin(R.work_scores(queries, "id", F.col("text"), index)).collect()), key=repr)
    found = R.top_works(queries, "id", F.col("text"), index)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert {12, 13, 14, None} <= {r[0] for r in expected}
    alone = R.top_works(queries.filter("id < 12"), "id", F.col("text"), index)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no gram of a text is shuffled
    monkeypatch.setattr(R, "HELD_ROWS", 10)
    assert sorted(map(tuple, R.top_works(queries, "id", F.col("text"), index).collect()), key=repr) == expected


def test_trigram_ranks_of_many_queries_at_once(spark):
    queries, lines = tables(spark)
    whole = R.trigram_candidates(queries, "id", "text", lines, "line", "text", top=5).select("query_id", "line_id", "shared", "rank")
    ranks = R.trigram_candidates(queries, "id", "text", lines, "line", "text", top=5, texts=False)
    assert ranks.columns == ["query_id", "line_id", "shared", "rank"]
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, whole.collect()))


def test_sequence_choices_are_those_of_difflib():
    import random

    rng = random.Random(3)
    text = lambda n, letters="abcdeé ": "".join(rng.choice(letters) for _ in range(n))
    texts = [text(rng.randint(1, 90)) for _ in range(120)] + ["ab" * 200, text(300), text(130) * 3, text(64), text(128)]
    texts += texts[:4]
    queries = [text(rng.randint(1, 100)) for _ in range(40)] + [texts[7], texts[9][3:] + "zß🙂", "zzz", "", "ab" * 150, texts[-7] + text(60)]
    ids = rng.sample(range(1000), len(texts))
    picks = [np.array(sorted(rng.sample(range(len(texts)), rng.randint(0, len(texts)))), np.int64) for _ in queries]
    found = M.SequenceChoices(texts, ids).best(queries, picks)
    for q, own, got in zip(queries, picks, found, strict=True):
        best = max(((SequenceMatcher(None, texts[k], q, autojunk=False).ratio(), -ids[k]) for k in own.tolist()), default=None)
        assert got == (best and (best[0], -best[1])), q
    assert any(x is None for x in found) or all(len(p) for p in picks)


def test_queries_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """The answers come from as many tasks as there are shuffle partitions, however few bytes the texts have."""
    queries, lines = tables(spark)
    parts = []
    written = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: (parts.append(df.rdd.getNumPartitions()) if name == "answers" else None) or written(df, name))
    R.sequence_best(queries, "id", "text", lines, "work", "line", "text")
    R.token_set_best(queries, "id", "text", lines, "line", "text").count()
    assert parts == 2 * [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_slices_side_by_side_are_those_of_pairs():
    """Longest runs (by bits, and cell by cell beyond 64), common subsequences and matching blocks of slices, however they lie in words."""
    rng = np.random.default_rng(5)
    sizes, others = rng.integers(1, 210, 60), rng.integers(1, 210, 60)
    sizes[3], others[4] = 200, 180
    text, other = rng.integers(0, 5, sizes.sum()), rng.integers(0, 4, others.sum())
    starts, begins = np.cumsum(sizes) - sizes, np.cumsum(others) - others
    text[starts[3] : starts[3] + sizes[3]] = 1
    other[begins[4] : begins[4] + others[4]] = 1
    pick, who = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    pick[:60], who[:60] = 3, 4
    cut = lambda n: np.sort(rng.integers(0, n[:, None] + 1, (len(n), 2)), axis=1).T
    (a0, a1), (low, high) = cut(sizes[pick]), cut(others[who])
    texts = M.TextPlaces(other, others, 5)
    open_ = (a1 > a0) & (high > low)
    found = [x.tolist() for x in (texts.subsequences(text, starts[pick] + a0, starts[pick] + a1, who, low, high), texts.matched(text, starts[pick] + a0, starts[pick] + a1, who, low, high))]
    longest = np.zeros((3, len(pick)), np.int64)
    longest[:, open_] = texts.longest(text, *((starts[pick] + x)[open_] for x in (a0, a1)), who[open_], low[open_], high[open_])
    seen = 0
    for k, (p, w) in enumerate(zip(pick.tolist(), who.tolist(), strict=True)):
        # 0 is like nothing: another number on either side.
        a = ["x" if c == 0 else str(c) for c in text[starts[p] + a0[k] : starts[p] + a1[k]]]
        b = ["y" if c == 0 else str(c) for c in other[begins[w] + low[k] : begins[w] + high[k]]]
        both = SequenceMatcher(None, a, b, autojunk=False)
        assert found[0][k] == M.common_subsequence(a, b)
        assert found[1][k] == sum(x.size for x in both.get_matching_blocks())
        block = both.find_longest_match(0, len(a), 0, len(b))
        assert longest[0][k] == block.size
        assert not block.size or (longest[1][k] - starts[p] - a0[k], longest[2][k] - low[k]) == (block.a, block.b)
        seen = max(seen, block.size)
    assert seen > 64


def test_token_sets_side_by_side_are_those_of_pairs(monkeypatch):
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    lines = [(k, said(rng.choice([1, 2, 5, 12, 30, 60]))) for k in rng.sample(range(1000), 80)] + [(2000, "x" * 62), (2001, "y" * 63), (2002, "z" * 700), (2003, said(400)), (2004, "  ")]
    queries = [said(rng.randint(1, 20)) for _ in range(60)] + ["", "  ", "x" * 62, "z" * 690, said(150), "qqq", "🙂 é", "x" * 61 + " y", lines[3][1] + " more of it"]
    for guess in (0.0, M.GUESS, 0.99):
        monkeypatch.setattr(M, "GUESS", guess)
        found = M.TokenSetLines(lines).bests(queries)
        for q, got in zip(queries, found, strict=True):
            best = max((M.token_set(q, t), -k) for k, t in lines if t.split())
            assert got == ((best[0], -best[1]) if q.split() else None), (guess, q)
    assert M.TokenSetLines([]).bests(["a", ""]) == [None, None]
