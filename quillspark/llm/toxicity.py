"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: on a bounded sample of labelled texts, near copies counted once, the document frequencies of words and word
beginnings give log-odds with an informative Dirichlet prior (the pooled frequencies); what counts is the lower
confidence bound, so chance words stay out.  Scoring: every token of a text has the best bound of its features, or a
small negative cost; a linear scan finds all maximal-scoring segments (Ruzzo and Tompa).  Calibration: for random tokens
the best segment follows an extreme-value law with parameters lambda and K, so a segment counts by lambda * S - ln(K n);
a logistic curve, fitted on the same sample, turns a text's sum over significant segments into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.folds import bounded_sample
from quillspark.llm.minhash import _WordHashes, shingle_hashes
from quillspark.plans.storage import materialize

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: Labelled texts that a model is fitted on, at most (about).
SAMPLE_ROWS = 20_000
CACHE_WORDS = 300_000
#: What a token costs that no feature speaks for.
COST = 0.25


def features(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    """Positive token scores by feature, the extreme-value law's lambda and ln K, and the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    bias: float = -5.0
    slope: float = 1.0
    slope_n: float = 0.0

    def word_score(self, word: str) -> float:
        return max([self.scores.get(f, -COST) for f in features(word)])

    def probability(self, strength: float, n: int) -> float:
        z = self.bias + self.slope * strength + self.slope_n * math.log1p(n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of token scores, in linear time."""
    out: list[list] = []  # [start, end, sum before start, sum at end, link to the nearest earlier one with less before]
    sums = np.concatenate([[0.0], np.cumsum(values)])
    for i in np.flatnonzero(values > 0).tolist():
        before, after = sums[i], sums[i + 1]
        candidate = [i, i + 1, before, after]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= candidate[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= candidate[3]:
                out.append([*candidate, j])
                break
            candidate = [out[j][0], candidate[1], out[j][2], candidate[3]]
            del out[j:]
    return [(a, b, float(e - s)) for a, b, s, e, _ in out]


class Scorer:
    """Scores texts with a model; the scores of words are kept."""

    def __init__(self, model: Model):
        self.model, self._cache = model, {}

    def values(self, text: str | None) -> np.ndarray:
        """The score of every token of the text."""
        words = _WORD.findall(text.lower()) if text else []
        cache, model = self._cache, self.model
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = model.word_score(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The text's number of tokens, and its significant segments as (first token, end, normalised score)."""
        values, model = self.values(text), self.model
        if not len(values):
            return 0, []
        base = model.log_k + math.log(len(values))
        found = [(a, b, model.rate * s - base) for a, b, s in maximal_segments(values)]
        return len(values), [x for x in found if x[2] > 0]

    def score(self, text: str | None) -> float:
        n, found = self.segments(text)
        return self.model.probability(sum(s for _, _, s in found), n)


def _near_copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHashes()
    for batch in batches:
        keys = []
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(text, cache)
            keys.append(int(hashes[0].view(np.int64)) if len(hashes) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["i", "y", "t", "near"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}
            counts[1 if y else 0].update(seen)
    for y in (0, 1):
        items = list(counts[y].items())
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            n = pa.array([c for _, c in part], pa.int64())
            zero = pa.array([0] * len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), zero if y else n, n if y else zero], ["f", "clean", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly penalised logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS, z: float = 3.0, least_docs: int = 3, least_score: float = 1.0) -> Model:
    """A model from labelled rows (label 1: toxic). Rows without label are ignored; without both classes, a flat score."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(label_col) > 0).alias("y"), F.col(text_col).cast("string").alias("t"))
    rows = bounded_sample(rows, "i", sample_rows)
    # Of near copies the row with the least id stands for all, so that every run fits the same model.
    keyed = rows.mapInArrow(_near_copy_key, f"i {rows.schema['i'].dataType.simpleString()}, y boolean, t string, near long")
    sample = materialize(keyed.groupBy("near", "y").agg(F.min(F.struct("i", "t")).alias("first")).select("y", "first.t"), "toxicity_sample")
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        flat = 1e-4 if not n1 else 1 - 1e-4
        return Model(bias=math.log(flat / (1 - flat)), slope=0.0)
    counts = sample.mapInArrow(_frequencies, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Prior: each class expects the pooled rate; its weight is `strength` documents.
    strength = 10.0
    pooled = (F.col("clean") + F.col("toxic") + 0.5) / F.lit(n0 + n1 + 1.0)
    hit, miss = F.col("toxic") + strength * pooled, F.lit(n1 + strength) - F.col("toxic") - strength * pooled
    hit0, miss0 = F.col("clean") + strength * pooled, F.lit(n0 + strength) - F.col("clean") - strength * pooled
    odds = F.ln(hit / miss) - F.ln(hit0 / miss0)
    bound = odds - z * F.sqrt(1 / hit + 1 / hit0)
    best = counts.filter(F.col("toxic") >= least_docs).withColumn("s", bound).filter(F.col("s") >= least_score).select("f", "s")
    model = Model(scores=dict(best.collect()))  # features of toxic texts of the bounded sample

    # Extreme-value law from clean texts: p of each score, sum p exp(lambda s) = 1.
    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(model), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = Counter(_WORD.findall((text or "").lower()))
                for w, c in words.items():
                    counts[round(scorer.model.word_score(w), 1)] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["s", "n"])

    spread = sample.filter(~F.col("y")).select("t").mapInArrow(clean_scores, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    s, n = np.array([r["s"] for r in spread]), np.array([r["n"] for r in spread], dtype=np.float64)
    p = n / max(n.sum(), 1.0)
    lo, hi = 1e-3, 4.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    model.rate = max(lo, 0.05)

    # K from the law's tail: of N clean tokens, K N exp(-lambda x) maximal segments reach x; x is the ninth decile of those found.
    def clean_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(model), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                values = scorer.values(text)
                counts[-1.0] += len(values)  # tokens
                counts.update(round(x, 1) for _, _, x in maximal_segments(values))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["s", "n"])

    tail = dict(sample.filter(~F.col("y")).select("t").mapInArrow(clean_segments, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect())
    tokens, reached, wanted = tail.pop(-1.0, 0), 0, 0.1 * sum(tail.values())
    model.log_k = math.log(1e-5)
    for x in sorted(tail, reverse=True):
        reached += tail[x]
        if reached >= wanted:
            model.log_k = max(model.log_k, math.log(reached / tokens) + model.rate * x)
            break

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.segments(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(x[2] for x in f) for _, f in found], pa.float64()), pa.array([k for k, _ in found], pa.int64())], ["y", "x", "n"])

    rows = sample.mapInArrow(strengths, "y boolean, x double, n long").collect()
    x = np.array([[1.0, r["x"], math.log1p(r["n"])] for r in rows])
    w = _logistic(x, np.array([float(r["y"]) for r in rows]))
    model.bias, model.slope, model.slope_n = map(float, w)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """A row per row of ``docs``: ``id_col``, ``text_hash``, ``score`` (0 to 1) and, with ``spans``, ``segments``.

    ``segments`` are the significant toxic passages as (token, end, score), tokens being runs of letters.  Defined cases:
    null and empty texts score as texts without segments; very long texts are scored whole; repeated rows get equal scores;
    null ids stay null; an empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    shared = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared)
        for batch in batches:
            found = [scorer.segments(t) for t in batch.column(2).to_pylist()]
            p = [shared.probability(sum(x[2] for x in f), n) for n, f in found]
            columns, names = [batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["k", "th", "score"]
            if spans:
                structs = [[{"token": a, "end": b, "score": s} for a, b, s in f] for _, f in found]
                columns.append(pa.array(structs, pa.list_(pa.struct([("token", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                names.append("segments")
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", segments array<struct<token:int,end:int,score:double>>" if spans else ""
    out = source.mapInArrow(run, f"k {kind}, th long, score double{extra}")
    return out.withColumnsRenamed({"k": id_col, "th": "text_hash"})


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; no row is moved.

    Null and empty texts score as texts without segments; ids are not read; repeated rows stay or go together; very long texts
    are scored whole; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
