"""Exact top-k search by BM25 with block-max dynamic pruning, per shard, merged with global statistics.

Documents become bags of hashed words.  Each task turns the documents that it reads into shards of bounded size, so no
text or posting is shuffled: a shard is an inverted index over its documents in order of their number of distinct words,
written as one row.  Global document frequencies, count and mean length give every shard the same weights.  A shard's
lists are cut at fixed blocks of documents, with the largest impact of each (term, block).  A query first sums these
maxima, then evaluates the most promising blocks; a block whose sum cannot reach the k-th score so far, in this shard or
an earlier one of the task, is skipped, so the answer is exact.  Queries come in blocks of bounded size, one job each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.plans.storage import materialize, new_path

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
K1, B = 1.2, 0.75
#: A shard is closed at so many documents (65,536 at most, their numbers have 16 bits) or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 50_000, 2_000_000
#: Documents of a block of a shard's lists.
BLOCK_DOCS = 64
#: Terms of a block of queries (about): what a job broadcasts is 16 bytes a term.
QUERY_TERMS = 500_000
CACHE_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def bag(text: str | None, cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts): signed 64-bit hashes of the words, in order. Words are runs of a-z, 0-9 and non-ASCII, A-Z lowered."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if len(cache) > CACHE_WORDS:
        cache.clear()
    terms, counts = np.unique(np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)).view(np.int64), return_counts=True)
    return terms, counts.astype(np.int32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for batch in batches:
        terms = [bag(t, cache)[0] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["id", "terms"])


_SHARD = pa.schema([("docs", pa.int64()), ("words", pa.int64()), *((c, pa.binary()) for c in ("ids", "lengths", "vocabulary", "df", "doc", "tf"))])
_SHARD_SQL = "docs long, words long, ids binary, lengths binary, vocabulary binary, df binary, doc binary, tf binary"


def _shard_row(ids: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One shard as arrays of bytes: documents in order of distinct words, postings in order of (term, document)."""
    sizes = np.array([len(t) for t, _ in bags])
    order = np.argsort(sizes, kind="stable")
    lengths = np.array([int(c.sum()) for _, c in bags], dtype=np.int64)[order]
    terms = np.concatenate([bags[i][0] for i in order])
    counts = np.concatenate([bags[i][1] for i in order])
    doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes[order])
    by_term = np.argsort(terms, kind="stable")
    vocabulary, df = np.unique(terms, return_counts=True)
    counts = counts[by_term].astype(np.min_scalar_type(int(counts.max(initial=0))))
    arrays = (np.array(ids, dtype=np.int64)[order], lengths, vocabulary, df.astype(np.int32), doc[by_term], counts)
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], schema=_SHARD)


def _build(shard_docs: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids, bags, postings = _Hashes(), [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                bags.append(bag(text.as_py(), cache))
                postings += len(bags[-1][0])
                if len(ids) >= shard_docs or postings >= shard_postings:
                    yield _shard_row(ids, bags)
                    ids, bags, postings = [], [], 0
        if ids:
            yield _shard_row(ids, bags)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each shard, a first step of the sum."""
    for batch in batches:
        for terms, df in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), dtype=np.int64)), pa.array(np.frombuffer(df.as_py(), dtype=np.int32).astype(np.int64))], ["term", "df"])


class Shard:
    """Inverted index of one shard with the largest impact of each (term, block of documents)."""

    def __init__(self, ids: bytes, lengths: bytes, vocabulary: bytes, df: bytes, doc: bytes, tf: bytes, mean: float):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.vocabulary = np.frombuffer(vocabulary, dtype=np.int64)
        self.doc = np.frombuffer(doc, dtype=np.uint16)
        count = np.frombuffer(tf, dtype=f"u{len(tf) // max(1, len(self.doc)) or 1}").astype(np.float64)
        norm = K1 * (1 - B + B * np.frombuffer(lengths, dtype=np.int64) / mean)
        self.impact = count * (K1 + 1) / (count + norm[self.doc])
        self.list = first = np.concatenate([[0], np.cumsum(np.frombuffer(df, dtype=np.int32), dtype=np.int64)])
        block = self.doc // BLOCK_DOCS
        cut = np.zeros(len(self.doc), dtype=bool)
        cut[first[:-1]] = True
        cut[1:] |= block[1:] != block[:-1]
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], len(self.doc)) if len(self.start) else self.start
        self.block = block[self.start].astype(np.int64)
        self.most = np.maximum.reduceat(self.impact, self.start) if len(self.start) else np.empty(0)
        self.first = np.searchsorted(self.start, first)
        self.blocks = len(self.ids) // BLOCK_DOCS + 1
        self.evaluated = 0

    def _score(self, entries: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of the impacts of these (term, block) entries, in the order of terms."""
        sizes = self.end[entries] - self.start[entries]
        self.evaluated += (total := int(sizes.sum()))
        at = np.arange(total) + np.repeat(self.start[entries] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.doc[at], weights=self.impact[at] * np.repeat(weight, sizes), minlength=self.blocks * BLOCK_DOCS)

    def _score_lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The same of whole lists, which are read in place."""
        lists = [slice(a, b) for a, b in zip(self.list[terms].tolist(), self.list[terms + 1].tolist(), strict=True)]
        sizes = self.list[terms + 1] - self.list[terms]
        self.evaluated += int(sizes.sum())
        impacts = np.concatenate([self.impact[x] for x in lists])
        impacts *= np.repeat(weights, sizes)
        return np.bincount(np.concatenate([self.doc[x] for x in lists]), weights=impacts, minlength=self.blocks * BLOCK_DOCS)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """The k best (-score, id) of this shard and of ``best``, in order; only documents that share a term. Scores have six places.

        Without k scores so far, the most promising blocks are evaluated first.  Then those follow that can still reach
        the k-th score: entry by entry, or, where they are most of the lists, by whole lists.
        """
        own = np.searchsorted(self.vocabulary, terms)
        known = own < len(self.vocabulary)
        known[known] = self.vocabulary[own[known]] == terms[known]
        own, weights = own[known], weights[known]
        if not len(own):
            return best
        lows = self.first[own]
        sizes = self.first[own + 1] - lows
        entries = np.arange(int(sizes.sum())) + np.repeat(lows - (np.cumsum(sizes) - sizes), sizes)
        weight, block = np.repeat(weights, sizes), self.block[entries]
        bound = np.bincount(block, weights=self.most[entries] * weight, minlength=self.blocks)
        scores, chosen = np.zeros(self.blocks * BLOCK_DOCS), np.zeros(self.blocks, dtype=bool)
        least = -best[-1][0] if len(best) == k else 0.0
        if not least and len(scores) > k:
            chosen[np.argsort(-bound, kind="stable")[: max(4, -(-2 * k // BLOCK_DOCS))]] = True
            mask = chosen[block]
            scores = self._score(entries[mask], weight[mask])
            least = np.partition(scores, -k)[-k]
        alive = (bound > 0) & (bound >= least - 1e-5) & ~chosen
        mask = alive[block]
        if 2 * np.count_nonzero(mask) > len(mask):
            scores = self._score_lists(own, weights)
        elif mask.any():
            scores += self._score(entries[mask], weight[mask])
        hit = np.flatnonzero((scores > 0) & (scores >= least - 1e-5))
        if len(hit) > k:
            hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k] - 1e-5]
        return sorted([*best, *((-round(float(scores[i]), 6), int(self.ids[i])) for i in hit)])[:k]


def _search(asked, mean: float, k: int):
    """(query_id, id, score): the k best of the task's shards for each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, offsets, terms, weights = asked.value
        best = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*(c[row].as_py() for c in batch.columns), mean)
                for q in range(len(queries)):
                    part = slice(offsets[q], offsets[q + 1])
                    best[q] = shard.search(terms[part], weights[part], k, best[q])
        found = [(queries[q], i, -score) for q, top in enumerate(best) for score, i in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.float64())], ["query_id", "id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(query_id, rank, id, score): the k documents of greatest BM25 score for each query row, its whole text as query.

    A job holds one block of queries, dealt by a hash of their ids to about ``query_terms`` terms a block, on the driver
    and in every worker; a query is never cut, so a block is at least as large as the longest query.  All documents are
    searched for every block.

    score = sum over the query's distinct words of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b +
    b len / mean len)), rounded to six places; ties by id.  Only documents that share a word are returned.  Defined cases:
    null and empty texts match nothing and count as documents of length 0; rows with a null id are no documents and no
    queries; repeated rows are ranked each, and a repeated query id stands for the words of all its rows; empty tables
    give no rows; other columns are not read.
    """

    spark = docs.sparkSession

    def source(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    # A file per shard: Spark's readers hold a batch of a file's rows at once, and a shard is one large row.
    path = new_path(spark, "shards")
    source(docs).mapInArrow(_build(min(shard_docs, 65_536), SHARD_POSTINGS), _SHARD_SQL).write.option("maxRecordsPerFile", 1).parquet(path)
    index = spark.read.schema(_SHARD_SQL).parquet(path)
    n, words = index.agg(F.sum("docs"), F.sum("words")).first()
    wanted = materialize(source(queries).mapInArrow(_bags, "id long, terms array<long>").select(F.col("id").alias("query_id"), F.explode("terms").alias("term")).distinct(), "wanted")
    total = wanted.count() if words else 0
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    mean, blocks = words / n, -(-total // query_terms)
    df = index.select("vocabulary", "df").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("q"))
    weighted = weighted.select("query_id", F.col("q.term").alias("terms"), F.col("q.w").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked_path, found_path = new_path(spark, "queries"), new_path(spark, "found")
    weighted.write.partitionBy("block").parquet(asked_path)
    asked = spark.read.schema("query_id long, terms array<long>, weights array<double>, block int").parquet(asked_path)
    # A task takes many shards: its scores so far prune the next ones, and it gives out k rows a query for all of them.
    postings = index.select("ids", "lengths", "vocabulary", "df", "doc", "tf").coalesce(spark.sparkContext.defaultParallelism)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).select("query_id", "terms", "weights").toArrow()
        terms, weights = rows.column("terms").combine_chunks(), rows.column("weights").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(), dtype=np.int64)])
        held = spark.sparkContext.broadcast((rows.column("query_id").to_pylist(), offsets, terms.flatten().to_numpy(), weights.flatten().to_numpy()))
        postings.mapInArrow(_search(held, mean, k), "query_id long, id long, score double").write.mode("append").parquet(found_path)
        held.destroy()
    found = spark.read.schema("query_id long, id long, score double").parquet(found_path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
