"""Quality by importance resampling.

Two generative models over hashed n-grams (words, pairs of words, and pairs of word shapes), one of target text and one of
the raw corpus, which is all of the documents, give each document an importance weight, the ratio of its likelihoods over
all its n-grams, whatever their number.  Resampling without replacement is Gumbel top-k: log weight plus Gumbel noise, the k greatest keys.  k is the stated count,
or else the expected number of target documents: the sum of their posteriors under the stated share of target text.
The k-th key is found by narrowing histograms, so no row is sorted globally or collected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.plans.storage import materialize

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
CACHE_WORDS = 300_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> str:
    """A token's class: its case and length for letters, itself for marks, 9 for digits."""
    if token.isalpha():
        case = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
        return f"{case}{min(len(token), 12) // 3}"
    return "9" if token[0].isdigit() else token[:4]


class _Tokens(dict):
    """A token's hash in the upper and its shape's in the lower 32 bits."""

    def __missing__(self, token: str) -> int:
        word, shape = (crc32(x.encode("utf-8", "surrogatepass")) for x in (token.lower(), _shape(token)))
        value = self[token] = word << 32 | shape
        return value


def _mix(grams: np.ndarray) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Features:
    """Buckets of a text's n-grams, with repeats: words, pairs of neighbouring words and of their shapes, and whether a word repeats the one before."""

    def __init__(self):
        self._cache = _Tokens()

    def buckets(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text) if text else []
        if not tokens:
            return np.empty(0, dtype=np.int64)
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        both = np.fromiter(map(self._cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        words, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        grams = [words * np.uint64(0x9E3779B1) + np.uint64(1)]
        if len(tokens) > 1:
            grams.append(words[:-1] * np.uint64(0xA24BAED5) + words[1:] * np.uint64(0x9FB21C65) + np.uint64(5))
            grams.append(shapes[:-1] * np.uint64(0x85EBCA77) + shapes[1:] * np.uint64(0xC2B2AE3D) + np.uint64(2))
            grams.append((words[1:] == words[:-1]).astype(np.uint64) * np.uint64(0x27D4EB2F) + np.uint64(3))
        return _mix(np.concatenate(grams))


@dataclass
class Model:
    """log(target / raw) by bucket, and the share of target text that is expected in the corpus."""

    log_ratio: np.ndarray
    share: float = 0.5

    def weight(self, features: Features, text: str | None) -> tuple[float, int]:
        """(log importance weight, n-grams): the sum of a text's log ratios, 0 without n-grams."""
        buckets = features.buckets(text)
        return float(self.log_ratio[buckets].sum()), len(buckets)

    def posterior(self, weight: float) -> float:
        """Probability of target text under the expected share."""
        if self.share >= 1:
            return 1.0
        z = weight + math.log(self.share / (1 - self.share))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def gumbel(noise: int) -> float:
    """Standard Gumbel noise from the bits of an integer."""
    return -math.log(-math.log(((noise & ((1 << 52) - 1)) + 0.5) / (1 << 52)))


def _counts(rows: DataFrame, text_col: str) -> np.ndarray:
    """How often each bucket occurs in all ``rows``; tasks sum their own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums, held, size = Features(), np.zeros(BUCKETS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(features.buckets(text.as_py()))
                size += len(held[-1])
                if size > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["b", "n"])

    sums = np.zeros(BUCKETS)
    found = rows.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most BUCKETS rows
        sums[r["b"]] = r["n"]
    return sums


def fit(raw: DataFrame, target: DataFrame, text_col: str = "text", share: float = 0.5, strength: float = 50.0) -> Model:
    """The models of ``target`` rows and of all ``raw`` rows. Without target text every weight is 1 and the share is whole.

    Both are smoothed by ``strength`` counts a bucket on the target's scale, so a bucket that either knows little of says little.
    """
    own, all_ = _counts(target, text_col), _counts(raw, text_col)
    if not own.sum() or not all_.sum():
        return Model(np.zeros(BUCKETS), 1.0)
    return Model(np.log((own + strength) / (all_ * (own.sum() / all_.sum()) + strength)), share)


def _noise(id_col: str, text_col: str, seed: int = 29):
    """64 random bits of a row, the same in every run."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string"))


_SCORES = {"log_weight": "double", "n_grams": "long", "posterior": "double", "key": "double"}


def _scored(docs: DataFrame, model: Model, text_col: str, id_col: str, names: list[str]) -> DataFrame:
    """``docs`` with the scores in columns of the given names; no row is moved."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [model.weight(features, t.as_py()) for t in batch.column(at)]
            w, n = [x[0] for x in found], [x[1] for x in found]
            keys = [x + gumbel(z) for x, z in zip(w, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            scores = [pa.array(w, pa.float64()), pa.array(n, pa.int64()), pa.array([model.posterior(x) if k else 0.0 for x, k in found], pa.float64()), pa.array(keys, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *scores], [*batch.schema.names[:-1], *names])

    fields = [*docs.schema.fields, *[T.StructField(n, T.DoubleType() if t == "double" else T.LongType()) for n, t in zip(names, _SCORES.values(), strict=True)]]
    return docs.select("*", _noise(id_col, text_col).alias("_q_noise")).mapInArrow(run, T.StructType(fields))


def weights(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, ``text_hash``, ``log_weight``, ``n_grams``, ``posterior`` and the Gumbel ``key``.

    The noise is a hash of seed, id and text, so it is the same in every run.  Null and empty texts have no n-grams, log
    weight 0 and posterior 0; very long texts are read whole; repeated rows get equal keys; null ids stay null; an empty
    table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    out = _scored(docs.select(F.col(id_col).alias("k"), text.alias("t"), F.xxhash64(text).alias("th")), model, "t", "k", list(_SCORES))
    return out.drop("t").withColumnsRenamed({"k": id_col, "th": "text_hash"})


def kth_greatest(rows: DataFrame, column: str, k: int, bins: int = 512, rounds: int = 12) -> float:
    """The k-th greatest value (k >= 1) of a finite double column: each round counts rows by bin and keeps one bin."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width or low + width == low:
            break
        part = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
        counts = part.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        if low == high:
            break
    return low


def resample(docs: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The weights with ``selected``: the k greatest keys (all, if there are fewer rows with n-grams; ties are all taken).

    Without ``k`` it is the expected number of target documents.  Rows without n-grams are never selected.  Repeated rows
    have equal keys and stay together; an empty table stays empty.
    """
    scored = materialize(weights(docs, model, id_col, text_col), "weights")
    return scored.withColumn("selected", (F.col("n_grams") > 0) & (F.col("key") >= least_key(scored, k)))


def least_key(scored: DataFrame, k: int | None = None, n_grams: str = "n_grams", posterior: str = "posterior", key: str = "key") -> float:
    """The k-th greatest key among rows with n-grams, k being the rounded sum of the posteriors unless given."""
    usable = scored.filter(F.col(n_grams) > 0)
    total, expected = usable.agg(F.count("*"), F.coalesce(F.sum(posterior), F.lit(0.0))).first()
    k = min(round(expected) if k is None else k, total)
    return kth_greatest(usable, key, k) if k > 0 else math.inf


def keep_selected(docs: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that resampling selects.

    Every text is scored once: rows are written with their keys, and those below the k-th are left out when they are read
    again.  Null and empty texts go; ties and repeated rows stay or go together; an empty table stays empty.
    """
    names = [f"_q_{n}" for n in _SCORES]
    scored = materialize(_scored(docs, model, text_col, id_col, names), "scored")
    least = least_key(scored, k, "_q_n_grams", "_q_posterior", "_q_key")
    return scored.filter((F.col("_q_n_grams") > 0) & (F.col("_q_key") >= least)).drop(*names)
