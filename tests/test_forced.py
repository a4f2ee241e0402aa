"""Works in recordings and the cursor over a word stream, against plain loops over everything."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import forced

GURMUKHI = ["ਸਤਿ ਨਾਮੁ ਕਰਤਾ ਪੁਰਖੁ", "ਆਦਿ ਸਚੁ ਜੁਗਾਦਿ ਸਚੁ", "ਹੈ ਭੀ ਸਚੁ ਨਾਨਕ ਹੋਸੀ ਭੀ ਸਚੁ"]


def test_words_keep_marks(spark):
    row = spark.createDataFrame([(f"<b>{GURMUKHI[0]}॥੧॥", None)], "a string, b string")
    a, b = row.select(forced.words_of(row["a"]), forced.words_of(row["b"])).first()
    assert a == ["b", *GURMUKHI[0].split(), "੧"] and b == []


def windows_hit(words, line, share):
    """Best Dice over all windows of as many words, and its first place among those that begin with one of its words."""
    n, m, best = len(line), len(words), None
    for j in range(max(1, m - n + 1)):
        w = words[j : j + n]
        score = 2 * sum((Counter(w) & Counter(line)).values()) / (n + len(w)) if w else 0.0
        if score > share and (w[0] in line or j == max(m - n, 0)) and (best is None or score > best[0]):
            best = score, j
    return best


@pytest.mark.parametrize("seed, index_bytes", [(0, 1 << 20), (1, 1 << 20), (2, 1 << 20), (0, 0), (1, 0), (3, 0)])
def test_line_hits(spark, seed, index_bytes):
    rng = random.Random(seed)
    vocabulary = ["the"] * 6 + [f"w{i}" for i in range(12)] + GURMUKHI[2].split()
    lines = [(w, i, [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]) for w in range(5) for i in range(4)]
    recordings = [(r, [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 120]))]) for r in range(12)] + [(90, []), (91, None)]
    for r in range(3):
        recordings[r][1].extend(lines[r][2])
    table = spark.createDataFrame(lines, "work long, line long, words array<string>")
    hits = forced.line_hits(spark.createDataFrame(recordings, "rec long, words array<string>"), "rec", "words", table, "work", "line", "words", index_bytes=index_bytes)
    expected = {}
    for rec, words in recordings:
        for work, line, target in lines:
            if len(" ".join(target)) >= 5 and words and (best := windows_hit(words, target, 0.55)):
                expected[rec, work, line] = best
    got = {(h.rec, h.work, h.line): (h.score, h.place) for h in hits.collect()}
    assert got == expected and expected
    confirmed = {(c.rec, c.work): (c.hits, c.n_lines) for c in forced.confirmed_works(hits, table, "work").collect()}
    counts = Counter((r, w) for r, w, _ in expected)
    assert confirmed == {k: (n, 4) for k, n in counts.items() if n >= 3 or (n >= 2 and n / 4 > 0.3)}


@pytest.mark.parametrize("seed", range(5))
def test_long_recordings_go_through_in_parts(seed):
    rng = random.Random(seed)
    lines = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for _ in range(30)]
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
    index = forced.LineIndex([(k, len(w), x, c) for k, w in enumerate(lines) for x, c in Counter(w).items()], 0.55)
    numbers = index.numbers(pa.array(words))
    whole = {k: (s, p) for k, s, p in index.hits(numbers)}
    assert whole == {k: windows_hit(words, w, 0.55) for k, w in enumerate(lines) if windows_hit(words, w, 0.55)}
    for part in (13, 50, 400):
        assert {k: (s, p) for k, s, p in index.hits(numbers, part)} == whole


def greedy(words, lines, floor, silence, common=0.0):
    """The cursor, one place after another."""
    out, i = [], 0
    while i < len(words):
        best, score, span = None, floor, 0
        for work, line, text in sorted(lines):
            n = len(text.split())
            for size in (n, n + 1, n - 1, n + 2):
                if size < 1 or i + size > len(words):
                    continue
                part = words[i : i + size]
                if silence is not None and any(b[1] - a[2] > silence for a, b in zip(part, part[1:])):
                    continue
                if sum(w[0] in text.split() for w in part) < common * n:
                    continue
                ratio = SequenceMatcher(None, " ".join(w[0] for w in part), text).ratio()
                if ratio > score:
                    best, score, span = (work, line), ratio, size
        if best:
            part = words[i : i + span]
            out.append((i, span, part[0][1], part[-1][2], round(score, 9), *best, " ".join(w[0] for w in part)))
            i += span
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed, silence, common, chunk", [(0, None, 0.0, 256), (1, None, 0.3, 5), (2, 1.0, 0.0, 5), (3, 0.5, 0.5, 256)])
def test_match_stream(spark, seed, silence, common, chunk):
    rng = random.Random(seed)
    texts = ["alpha beta gamma delta", "beta gamma", "delta epsilon zeta eta theta", "iota", "gamma delta epsilon", *GURMUKHI]
    lines = [(s, k // 3, k, t) for s in range(3) for k, t in enumerate(texts) if s < 2 or k % 2]
    noise = ["xx", "qqq", "alpa", "gama", "ਸਤ", "delta", "iota"]
    words = []
    for session, size in ((0, 40), (1, 9), (2, 60), (7, 5)):
        stream, clock = [], 0.0
        while len(stream) < size:
            stream += rng.choice(texts).split() if rng.random() < 0.6 else [rng.choice(noise)]
        for pos, word in enumerate(stream):
            clock += rng.choice([0.1, 0.1, 0.7, 1.5])
            words.append((session, pos, word, round(clock, 3), round(clock + 0.3, 3), 0.5))
            clock += 0.3
    table = spark.createDataFrame(words, "session long, pos long, word string, start double, end double, confidence double")
    found = forced.match_stream(table, spark.createDataFrame(lines, "session long, work long, line long, text string"), silence=silence, common=common, chunk=chunk).collect()
    for s in (0, 1, 2, 7):
        expected = greedy([(w[2], w[3], w[4]) for w in words if w[0] == s], [x[1:] for x in lines if x[0] == s], 0.45, silence, common)
        got = sorted((r.pos, r.n_words, r.start, r.end, round(r.score, 9), r.work, r.line, r.raw_text) for r in found if r.session == s)
        assert got == expected
    assert all(abs(r.confidence - 0.5) < 1e-9 for r in found)


def test_long_recording(spark):
    """Spans that all reach over each other, over many tasks' worth of places; and none at all."""
    size = lambda p: 1 + p * 7919 % 5
    places = spark.range(20_000).selectExpr("1L AS session", "id AS pos", "1 + id * 7919 % 5 AS size", "'x' AS word")
    expected, cursor = [], 0
    while cursor < 20_000:
        expected.append(cursor)
        cursor += size(cursor)
    assert sorted(r.pos for r in forced.consume(places).collect()) == expected
    assert forced.consume(places.limit(0)).count() == 0
    empty = spark.createDataFrame([], "session long, work long, line long, text string")
    words = spark.createDataFrame([(1, 0, None, None, None, None)], "session long, pos long, word string, start double, end double, confidence double")
    assert forced.match_stream(words, empty).count() == 0
    assert forced.match_stream(words, spark.createDataFrame([(1, 1, 1, None), (1, 1, 2, " a  b ")], empty.schema)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.3])
def test_windows_of_many_parts_side_by_side(common):
    rng = random.Random(4)
    texts = ["alpha beta gamma delta", "beta gamma", "delta epsilon zeta eta theta", "iota", "gamma delta epsilon", "eta zeta epsilon"]
    words = lambda n: [rng.choice(["alpha", "beta", "gama", "delta", "zeta", "eta", "", "ßß🙂", "iota"]) for _ in range(n)]
    parts = [(forced.Part(words(n), np.cumsum([0, *(rng.random() < 0.1 for _ in range(n - 1))]), low, n), texts[k:]) for k, (n, low) in enumerate([(30, 0), (1, 0), (50, 7)])]
    found = list(forced.best_windows(parts, [p.lanes(lines, common) for p, lines in parts], 0.45))
    for k, (part, lines) in enumerate(parts):
        every = [(i, ratio, n, window, size) for n, t in enumerate(lines) for i, window, size, ratio in part.best(t, 0.45, common)]
        top = {i: max(r for j, r, *_ in every if j == i) for i, *_ in every}
        assert sorted((i, r, n, w, s) for row, n, i, w, s, r in found if row == k) == sorted(x for x in every if x[1] == top[x[0]])
