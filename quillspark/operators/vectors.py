"""Vector search over normalised embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import grams as G

#: Query vectors that a block of queries holds; the block is what a task keeps in memory.
BLOCK = 1024
#: Vectors of a lot, about.
LOT = 20_000


def normalize(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.withColumn(vector, G.normalized(F.col(vector)))


def knn(queries: DataFrame, query: str, vectors: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by inner product, ties by id.

    The queries are a stated set, gathered in blocks of ``BLOCK``; each block meets each partition of the vectors once, as a
    matrix product, and leaves k candidates a query and Arrow batch: the shuffle carries candidates only.
    """
    packed = queries.select(F.col(query).alias("q"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    blocks = packed.withColumn("b", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("q"), F.lit(64))).orderBy("q")) - 1) / BLOCK)).withColumn("p", F.pmod(F.xxhash64("q"), F.lit(64)))
    blocks = blocks.groupBy("p", "b").agg(F.collect_list(F.struct("q", "v")).alias("queries")).select("queries")
    base = vectors.select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    lots = base.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-vectors.count() // LOT)))).alias("lot")).agg(F.collect_list(F.struct("id", "x")).alias("lot_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, rows in zip(batch.column(0), batch.column(1), strict=True):
                q, r = pa.array(qs.values), pa.array(rows.values)
                qv = np.stack(q.field("v").to_numpy(zero_copy_only=False))
                rv = np.stack(r.field("x").to_numpy(zero_copy_only=False))
                ids, names = r.field("id").to_numpy(), q.field("q").to_numpy()
                scores = qv @ rv.T
                n = min(k, len(ids))
                out_q, out_i, out_s = [], [], []
                for i, row in enumerate(scores):
                    order = np.lexsort((ids, -row))[:n]
                    out_q += [names[i]] * n
                    out_i += ids[order].tolist()
                    out_s += row[order].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "id", "score"])

    met = blocks.join(lots.select("lot_rows"), how="cross").select("queries", "lot_rows")
    found = met.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, vector): the mean of each group's vectors, normalised; partial sums per position, no vector is gathered."""
    long = vectors.select(group, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    rows = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"), F.max("n").alias("n"))
    return rows.select(group, "n", G.normalized(F.transform("p", lambda e: e["m"])).alias(vector))


def group_hits(hits: DataFrame, work: str) -> DataFrame:
    """Per query and work: hits, sum and best of scores, and the best hit (ties by id)."""
    best = F.max(F.struct("score", (-F.col("id")).alias("neg")))
    out = hits.groupBy("query_id", work).agg(F.count("*").alias("hits"), F.sum("score").alias("total"), best.alias("b"))
    return out.select("query_id", work, "hits", "total", F.col("b.score").alias("best"), (-F.col("b.neg")).alias("best_id"))


def hybrid(groups: DataFrame, work: str, literal: DataFrame | None, confirmed: DataFrame, floor: float = 0.5, weight: float = 0.4, agree: float = 1.1, differ: float = 0.9, top: int = 5) -> DataFrame:
    """Works ranked by (1 - weight) * best cosine + weight * literal overlap, more if the work-level search agrees.

    ``literal`` is (query_id, work, overlap), or None for the mode by meaning alone, where the cosine counts whole; the
    mode by letters alone is :func:`retrieval.literal_search`.  ``confirmed`` is (query_id, work), the work-level best.  A
    query whose best cosine is below ``floor`` has no answer.  Adds ``ui``: the score's place between the query's least (0
    for a single work) and greatest, mapped to 0.5 .. 1.
    """
    w = Window.partitionBy("query_id")
    c = confirmed.select("query_id", F.col(work).alias("top_work"))
    rows = groups.withColumn("_best", F.max("best").over(w)).filter(F.col("_best") >= floor).join(c, "query_id", "left")
    if literal is not None:
        rows = rows.join(literal, ["query_id", work], "left")
    blend = F.col("best") if literal is None else (1 - weight) * F.col("best") + weight * F.coalesce("overlap", F.lit(0.0))
    rows = rows.withColumn("confirmed", F.coalesce(F.col(work) == F.col("top_work"), F.lit(False))).withColumn("score", blend * F.when(F.col("confirmed"), agree).otherwise(differ))
    low = F.when(F.count("*").over(w) > 1, F.min("score").over(w)).otherwise(F.lit(0.0))
    ui = 0.5 + 0.5 * (F.col("score") - low) / F.greatest(F.max("score").over(w) - low, F.lit(1e-6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), work)
    ranked = rows.withColumns({"ui": F.least(F.greatest(ui, F.lit(0.0)), F.lit(1.0)), "rank": F.row_number().over(order)})
    return ranked.filter(F.col("rank") <= top).select("query_id", work, "score", "ui", "confirmed", "rank")


def snap(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The nearest hit where it is near enough, else null and the tag 'none'."""
    top = hits.filter("rank = 1")
    near = F.col("score") >= threshold
    return top.select("query_id", F.when(near, F.col("id")).alias("id"), F.when(near, "snapped").otherwise("none").alias("tag"))
