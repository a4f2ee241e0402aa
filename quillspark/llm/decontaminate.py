"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in k-grams; of every ``span - k + 1`` neighbouring k-grams the least hash is kept as a fingerprint.
Two texts that share ``span`` words share a window of k-grams and so its least hash: joining the documents' fingerprints
with the benchmark's finds every shared span.  Hits are then extended: each window whose least hash the fingerprint is
(a run of neighbours, and every window is in one run only) is compared, as a string, with the benchmark's windows, so hash
collisions and chance matches leave no trace and a text costs time in proportion to its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.storage import materialize

#: The word pattern and the letters that are lower-cased.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fingerprints or windows of the benchmark up to which it is broadcast (about 64 MB); beyond, the joins shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def _indices(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kgram_hashes(word_hashes: Column, n: Column, k: int) -> Column:
    return F.transform(_indices(n - (k - 1)), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(k)]))


def _window_minima(kgrams: Column, n: Column, span: int, k: int) -> Column:
    """The least k-gram hash of every window of ``span`` words."""
    width = span - k + 1
    if width == 1:
        return kgrams
    return F.transform(_indices(n - (span - 1)), lambda i: F.least(*[F.get(kgrams, i + j) for j in range(width)]))


def _join_string(parts: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(parts, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """(item, win, len): every distinct window of each item; an item with fewer words than ``span`` is one window."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w"))
    n = F.size("w")
    starts = _indices(F.when(n == 0, 0).otherwise(F.greatest(n - (span - 1), F.lit(1))))
    return (
        w.select("item", "w", F.explode(starts).alias("s"))
        .select("item", _join_string(F.col("w"), F.col("s"), span).alias("win"), F.least(F.size("w"), F.lit(span)).alias("len"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Which words of each document lie in a window of ``span`` consecutive benchmark words.

    Returns a row per row of ``docs``: ``id_col``, ``text_hash`` (xxhash64 of the text), ``n_words``, ``n_hit``,
    ``hits`` (array of (s, len): word positions of matched windows), ``items`` (sorted ids, as strings, of items with
    occurring windows).  Defined cases: null and empty texts have no words and no hits; null ids are kept; repeated rows
    come out as often as they came in, with equal answers; null items and items without words are ignored; a very long text
    costs time in proportion to its length, matched or not; empty tables give no rows or no hits; other columns are not read.
    """
    windows = materialize(benchmark_windows(benchmark, span, item_col, item_text_col), "benchmark_windows")
    short = sorted(r[0] for r in windows.filter(F.col("len") < span).select("len").distinct().collect())  # below span, so few
    small = windows.count() <= broadcast_rows
    side = F.broadcast if small else (lambda x: x)

    parts = F.split("win", " ")
    hashed = windows.select("win", "len").distinct().withColumn("h", F.transform(parts, lambda x: F.xxhash64(x)))
    full = hashed.filter(F.col("len") == span).withColumn("g", _kgram_hashes(F.col("h"), F.lit(span), k)).select(F.array_min("g").alias("fp"), F.lit(span).alias("fp_len"))
    marks = [full]
    for m in short:
        marks.append(hashed.filter(F.col("len") == m).select(F.xxhash64(*[F.get("h", F.lit(j)) for j in range(m)]).alias("fp"), F.lit(m).alias("fp_len")))
    marks = reduce(DataFrame.unionByName, marks).distinct()

    # Equal rows of a task are one group with a count; ``part`` keeps those of different tasks apart, so none is hot.
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("th"), F.spark_partition_id().alias("part"), words(text).alias("w"))
    base = base.withColumn("n", F.size("w")).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    base = base.withColumn("kg", _kgram_hashes(F.col("wh"), F.col("n"), k)).withColumn("least", _window_minima(F.col("kg"), F.col("n"), span, k))
    # A fingerprint stands for the run of windows that have it as their least hash: from its place to the next one's.
    changes = F.filter(_indices(F.size("least")), lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1)))
    base = base.withColumn("runs", changes)

    def print_(fp: Column, length: int, low: Column, high: Column) -> Column:
        return F.struct(fp.alias("fp"), F.lit(length).alias("fp_len"), low.alias("low"), high.alias("high"))

    def shown(length: int):
        return lambda x, i: print_(x, length, i, i + 1)

    none = F.lit(None)
    prints = [F.array(print_(none.cast("long"), 0, none.cast("int"), none.cast("int")))]
    prints.append(F.transform("runs", lambda i, at: print_(F.get("least", i), span, i, F.coalesce(F.get("runs", at + 1), F.size("least")))))
    prints += [F.transform(_kgram_hashes(F.col("wh"), F.col("n"), m), shown(m)) for m in short]
    carried = ["k", "th", "part", "n"]
    if small:  # the words ride along: rows without a partner are dropped before they are copied
        rows = base.select(*carried, "w", F.explode(F.concat(*prints)).alias("f")).select(*carried, "w", "f.*")
        found = rows.join(F.broadcast(marks.withColumn("known", F.lit(True))), ["fp", "fp_len"], "left").filter(F.col("fp").isNull() | F.col("known"))
    else:
        rows = base.select("k", "th", F.explode(F.concat(*prints[1:])).alias("f")).select("k", "th", "f.*")
        known = rows.join(marks, ["fp", "fp_len"], "left_semi").distinct().withColumn("f", F.struct("fp", "fp_len", "low", "high"))
        known = materialize(known.groupBy("k", "th").agg(F.collect_list("f").alias("fs")), "known_prints")  # of one text, so bounded by it
        keys = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("k", "th")]
        found = base.select(*carried, "w").alias("b").join(known.alias("f"), keys, "left").select("b.*", F.explode(F.concat(prints[0], F.coalesce("fs", F.slice(prints[0], 1, 0)))).alias("f"))
        found = found.select(*carried, "w", "f.*")

    # The windows that a fingerprint stands for, each once, as strings.
    starts = F.when(F.col("low").isNotNull(), F.sequence("low", F.col("high") - 1))
    spots = found.select(*carried, "w", "fp_len", F.explode_outer(starts).alias("s"))
    spots = spots.select(*carried, "s", F.col("fp_len").alias("len"), F.when(F.col("s").isNotNull(), _join_string(F.col("w"), F.col("s"), F.col("fp_len"))).alias("win"))

    per_window = windows.select("win", "len", "item")
    matched = spots.join(side(per_window), ["win", "len"], "left").filter(F.col("s").isNull() | F.col("item").isNotNull())
    spot = F.when(F.col("item").isNotNull(), F.struct("s", "len"))
    out = matched.groupBy(*carried).agg(F.count_if(F.col("s").isNull()).alias("rows"), F.sort_array(F.collect_set(spot)).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def cover(acc, x):
        end = x["s"] + x["len"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["s"]))).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    return out.select(
        F.col("k").alias(id_col), F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_words"),
        F.aggregate("hits", zero, cover, lambda a: a["hit"]).cast("long").alias("n_hit"), "hits", "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no window with the benchmark.

    Repeated rows stay repeated or go together; null and empty texts stay; a null id is compared as a value; an empty
    benchmark keeps everything.
    """
    hit = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter(F.col("n_hit") > 0)
    hit = hit.select(F.col(id_col).alias("_q_id"), F.col("text_hash").alias("_q_hash")).distinct()
    same = docs[id_col].eqNullSafe(hit["_q_id"]) & (F.xxhash64(docs[text_col].cast("string")) == hit["_q_hash"])
    return docs.join(hit, same, "left_anti")
