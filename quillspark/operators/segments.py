"""Segments from ordered cues, words and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_groups(rows: DataFrame, key: str, start: Column, previous_end: Column, gap: float, order: list[str], out: str = "group") -> DataFrame:
    """``out``: a number per key that grows where the time since the previous row exceeds ``gap``."""
    w = Window.partitionBy(key).orderBy(*order)
    opens = F.coalesce((start - F.lag(previous_end).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_open", opens).withColumn(out, F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def chunked_groups(rows: DataFrame, key: str, group: str, order: list[str], size: int, out: str = "part") -> DataFrame:
    """``out``: each group cut after every ``size`` rows."""
    w = Window.partitionBy(key, group).orderBy(*order)
    return rows.withColumn(out, F.floor((F.row_number().over(w) - 1) / size))


def pair_cues(cues: DataFrame, key: str, start: str, end: str, text: str, gap: float = 2.0) -> DataFrame:
    """Cues of a group (gaps below ``gap``) joined two by two; an end never passes the next pair's start."""
    rows = gap_groups(cues, key, F.col(start), F.col(end), gap, [start, end])
    rows = chunked_groups(rows, key, "group", [start, end], 2, "pair")
    pairs = rows.groupBy(key, "group", "pair").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(start, text))), lambda s: s[text]), " ").alias(text), F.count("*").alias("n_cues"),
    )
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    return pairs.withColumn(end, F.least(F.col(end), F.coalesce(after, F.col(end))))


def pause_segments(words: DataFrame, key: str, start: str, end: str, gap: float, most: int = 15) -> DataFrame:
    """Segments that end at a pause or after ``most`` words: (key, group, part, start, end, n)."""
    rows = gap_groups(words, key, F.col(start), F.col(end), gap, [start, end])
    rows = chunked_groups(rows, key, "group", [start, end], most)
    return rows.groupBy(key, "group", "part").agg(F.min(start).alias("seg_start"), F.max(end).alias("seg_end"), F.count("*").alias("n"))


def midpoint_buckets(cues: DataFrame, start: str, end: str, width: float, offset: float = 0.0) -> DataFrame:
    """``bucket``: the window of ``width`` that holds a cue's midpoint."""
    return cues.withColumn("bucket", F.floor(((F.col(start) + F.col(end)) / 2 + offset) / width))


def tail_windows(sessions: DataFrame, total: str, width: float, least_tail: float, stride: float | None = None, pad: bool = False) -> DataFrame:
    """(.., i, start, end): fixed or overlapping windows over each session's length; a shorter last one is dropped, or padded."""
    stride = width if stride is None else stride
    n = F.ceil(F.col(total) / stride).cast("int")
    rows = sessions.withColumn("i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumns({"win_start": F.col("i") * stride, "win_end": F.least(F.col("i") * stride + width, F.col(total))})
    rows = rows.filter((F.col("win_end") - F.col("win_start") >= least_tail) & ((F.col("i") == 0) | (F.col("win_start") + (width - stride) < F.col(total))))
    return rows.withColumn("win_end", F.col("win_start") + width) if pad else rows


def overlap_dedup(words: DataFrame, key: str, start: str, end: str, slack: float = 0.1) -> DataFrame:
    """Words that start no earlier than ``slack`` before the greatest end so far; the fold over a session's words as an array."""
    rows = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(start, end, *[c for c in words.columns if c not in (key, start, end)]))).alias("w"))
    element = rows.schema["w"].dataType.simpleString()
    zero = F.struct(F.array().cast(element).alias("kept"), F.lit(float("-inf")).alias("last"))

    def step(acc, word):
        keep = word[start] > acc["last"] - slack
        return F.struct(F.when(keep, F.concat(acc["kept"], F.array(word))).otherwise(acc["kept"]).alias("kept"), F.when(keep, word[end].cast("double")).otherwise(acc["last"]).alias("last"))

    return rows.select(key, F.explode(F.aggregate("w", zero, step, lambda a: a["kept"])).alias("x")).select(key, "x.*")


def events_to_segments(events: DataFrame, key: str, ts: str, value: str, order: list[str], end: Column | None = None) -> DataFrame:
    """(key, seg_start, seg_end, value, n): an event lasts until the next; equal neighbours are one, empty values leave gaps."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumns({"_next": F.lead(ts).over(w), "_new": F.coalesce((F.lag(value).over(w).eqNullSafe(F.col(value)) == F.lit(False)).cast("int"), F.lit(1))})
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.coalesce(F.max("_next"), F.max(ts) if end is None else end)
    out = rows.groupBy(key, "_run", value).agg(F.min(ts).alias("seg_start"), stop.alias("seg_end"), F.count("*").alias("n"))
    return out.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").drop("_run")


def push_dedup(events: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """Events whose values differ from those of the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.lag(v).over(w).eqNullSafe(F.col(v)) for v in values])
    return events.withColumn("_same", same & (F.row_number().over(w) > 1)).filter(~F.col("_same")).drop("_same")


def proximity_join(left: DataFrame, right: DataFrame, word: str, ts: str, id_: str, within: float) -> DataFrame:
    """(id, other, delta): for each left row the nearest right row of the same word within ``within`` seconds, ties by id.

    Time is cut in buckets of ``within``. The nearest row is the last before or the first after, in the bucket of the left
    row or, if it has none on that side, at the near end of the neighbouring bucket: rows are never paired with all others of
    a bucket, so the work does not grow with their density.
    """
    bucket = F.floor(F.col(ts) / within)
    real = F.col(word).isNotNull() & F.col(ts).isNotNull() & ~F.isnan(F.col(ts).cast("double"))
    a = left.filter(real).select(F.col(word).alias("w"), bucket.alias("b"), F.col(ts).alias("t"), F.col(id_).alias("id"), F.lit(True).alias("asks"))
    b = right.filter(real).select(F.col(word).alias("w"), bucket.alias("b"), F.col(ts).alias("t"), F.col(id_).alias("id"), F.lit(False).alias("asks"))
    ends = b.groupBy("w", "b").agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("t"), F.min_by("id", F.struct(-F.col("t"), F.col("id"))).alias("id"))
    # A bucket's ends are also rows of its neighbours.
    above = ends.select("w", (F.col("b") + 1).alias("b"), "t", "id", F.lit(False).alias("asks"))
    below = ends.select("w", (F.col("b") - 1).alias("b"), F.col("first.t").alias("t"), F.col("first.id").alias("id"), F.lit(False).alias("asks"))
    rows = a.unionByName(b).unionByName(above).unionByName(below)
    # Of equal times the least id is the last on either way, and left rows follow the right rows of their time.
    told = F.when(~F.col("asks"), F.struct("t", F.col("id")))
    group = Window.partitionBy("w", "b")
    before = F.last(told, ignorenulls=True).over(group.orderBy("t", "asks", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(told, ignorenulls=True).over(group.orderBy(F.desc("t"), "asks", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumns({"before": before, "after": after}).filter("asks").select("id", "t", F.explode(F.array("before", "after")).alias("x")).filter("x IS NOT NULL")
    delta = F.col("x.t") - F.col("t")
    near = near.filter(F.abs(delta) <= within)
    best = near.groupBy("id").agg(F.min(F.struct(F.abs(delta).alias("d"), F.col("x.id").alias("other"), delta.alias("delta"))).alias("m"))
    return best.select("id", F.col("m.other").alias("other"), F.col("m.delta").alias("delta"))


def pad_segments(rows: DataFrame, start: str, end: str, total: Column, before: float = 0.15, after: float = 0.3, least: float = 1.5, most: float = 30.0) -> DataFrame:
    """Segments padded, clamped to the session and of a valid length."""
    out = rows.withColumns({start: F.greatest(F.col(start) - before, F.lit(0.0)), end: F.least(F.col(end) + after, total)})
    return out.filter((F.col(end) - F.col(start)).between(least, most))


def repair_min_sec(rows: DataFrame, session: str, start: str, end: str, duration: str) -> DataFrame:
    """Times written as minutes.seconds become seconds where a session's last end is below a tenth of its length."""
    wrong = F.max(end).over(Window.partitionBy(session)) < F.col(duration) / 10

    def seconds(c: str) -> Column:
        return F.floor(F.col(c)) * 60 + F.round((F.col(c) - F.floor(F.col(c))) * 100)

    return rows.withColumns({c: F.when(wrong, seconds(c)).otherwise(F.col(c)) for c in (start, end)})
