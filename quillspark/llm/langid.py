"""Multilingual mixture inference from n-gram likelihoods.

A text is a bag of letter trigrams drawn from a mixture of languages.  Each language's trigram probabilities come from
all training texts (hashed to a fixed number of buckets, additively smoothed); expectation-maximisation estimates a text's
language proportions, and the set of languages is the one of greatest likelihood less a penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed trigrams; the model holds one number per bucket and language.
BUCKETS = 1 << 16
UNDETERMINED = "und"


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text's lower-cased letter trigrams, words fenced by blanks; None without a letter."""
    if not text:
        return None
    kept = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower()
    codes = np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if text.isascii():
        codes = np.where((codes >= 97) & (codes <= 122), codes, 32).astype(np.uint32)
    if not (codes != 32).any():
        return None
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]  # runs of blanks are one
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.unique((mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1), return_counts=True)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket x language

    def mixture(self, text: str | None, iterations: int = 25, penalty: float = 1.0) -> dict[str, float]:
        """Proportions of the selected languages, by falling proportion; empty for a text without letters."""
        grams = trigram_counts(text)
        if grams is None or not self.languages:
            return {}
        buckets, counts = grams
        log_p, counts = self.log_p[buckets], counts.astype(np.float64)
        peak = log_p.max(axis=1, keepdims=True)
        p, total = np.exp(log_p - peak), counts.sum()

        def em(chosen: list[int]) -> tuple[np.ndarray, float]:
            q = p[:, chosen]
            share = np.full(len(chosen), 1 / len(chosen))
            for _ in range(iterations if len(chosen) > 1 else 1):
                joint = q @ share
                new = share * (q.T @ (counts / np.maximum(joint, 1e-300))) / total
                moved = np.abs(new - share).max()
                share = new
                if moved < 1e-4:
                    break
            return share, float(counts @ np.log(np.maximum(q @ share, 1e-300)))

        full, _ = em(list(range(len(self.languages))))
        order = np.lexsort((np.arange(len(full)), -full)).tolist()
        best, best_value = None, -np.inf
        for size in range(1, len(order) + 1):  # nested sets, by falling proportion
            chosen = order[:size]
            share, likelihood = em(chosen)
            value = likelihood - penalty * (size - 1) * np.log(max(total, 2.0))
            if value <= best_value:
                break
            best, best_value = (chosen, share), value
        chosen, share = best
        ranked = sorted(zip((self.languages[i] for i in chosen), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return dict(ranked)


def fit(rows: DataFrame, text_col: str, lang_col: str, smoothing: float = 0.5) -> Model:
    """Trigram probabilities from every row whose language is not null. Counts are summed within each task first."""
    source = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                if (grams := trigram_counts(text)) is not None:
                    own[grams[0]] += grams[1]
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["l", "b", "n"])

    counts = source.mapInArrow(count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for r in counts.groupBy("l").agg(F.collect_list(F.struct("b", "n")).alias("x")).collect():  # at most BUCKETS a language
        own = by_lang.setdefault(r["l"], np.zeros(BUCKETS))
        for b, n in r["x"]:
            own[b] = n
    languages = sorted(by_lang)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    table = np.stack([by_lang[x] for x in languages], axis=1) + smoothing
    return Model(languages, np.log(table / table.sum(axis=0)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``id_col``, ``lang_pred``, ``score`` (its proportion), ``languages`` (array of lang, share).

    Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no languages, as is every text if
    nothing was learnt; very long texts are read whole; ties go to the language first in order; repeated rows get equal answers; null ids stay null; an
    empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    shared = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.mixture(t) for t in batch.column(1).to_pylist()]
            top = [next(iter(f.items()), (UNDETERMINED, 0.0)) for f in found]
            parts = [[{"lang": k, "share": v} for k, v in f.items()] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t[0] for t in top], pa.string()), pa.array([min(1.0, t[1]) for t in top], pa.float64()), pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                ["k", "lang_pred", "score", "languages"],
            )

    out = source.mapInArrow(run, f"k {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("k", id_col)
