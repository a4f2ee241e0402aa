"""Aggregates for reports; all merge partial results before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by key, and each count's share of all as parts in a million."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a key
    return counts.withColumn("ppm", F.floor(F.col("n") * 1_000_000 / total).cast("long"))


def bucket_counts(rows: DataFrame, value: Column, thresholds: list[float]) -> DataFrame:
    """One row: n, mean, median, least, greatest and the number of values at or above each threshold."""
    ge = [F.count_if(value >= t).alias(f"ge_{str(t).replace('.', '_')}") for t in thresholds]
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"), *ge)


def median_iqr(rows: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """(key, n, median, iqr): quartiles as medians of the halves, the middle value in neither; null below ``least`` values.

    Values are counted first, and read off at their places in the running counts: no list of a key's values is made.
    Null values are left out; a key with no others has n 0.
    """
    counts = rows.groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_c"))
    in_order = Window.partitionBy(key).orderBy("_v")
    counts = counts.withColumn("_to", F.sum("_c").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))

    def middle(first: Column, n: Column) -> Column:
        """Median of ``n`` values from the 0-based ``first`` on."""
        low, high = (F.max(F.when((F.col("_to") - F.col("_c") <= at) & (at < F.col("_to")), F.col("_v"))) for at in (first + F.floor((n - 1) / 2), first + F.floor(n / 2)))
        return (low + high) / 2

    n = F.col("_n")
    half = F.floor(n / 2)
    iqr = middle(n - half, half) - middle(F.lit(0), half)
    return counts.groupBy(key).agg(F.max("_n").alias("n"), middle(F.lit(0), n).alias("median"), iqr.alias("_iqr")).select(key, "n", "median", F.when(F.col("n") >= least, F.col("_iqr")).alias("iqr"))


def error_rate(rows: DataFrame, edits: Column, units: Column, *keys: str) -> DataFrame:
    """Edits per reference unit over the whole corpus, in per cent, by key; null without units."""
    sums = rows.groupBy(*keys).agg(F.sum(edits).alias("edits"), F.sum(units).alias("units"))
    return sums.withColumn("rate", F.when(F.col("units") > 0, 100.0 * F.col("edits") / F.col("units")))


def recogniser_report(rows: DataFrame, edits: Column, units: Column, audio: str, decode: str, order: list[str], *keys: str) -> DataFrame:
    """Error rate, real-time factor (seconds of decoding per second of audio) and the first row's decoding time, by key.

    Null seconds count 0 in the sums; without audio the factor's divisor is 1e-6.
    """
    def exact(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,4)")).cast("double")

    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(edits).alias("edits"), F.sum(units).alias("units"), exact(audio).alias("audio_s"), exact(decode).alias("decode_s"), F.min(F.struct(*order, decode))[decode].alias("first_latency_s"),
    )
    rate = F.when(F.col("units") > 0, 100.0 * F.col("edits") / F.col("units"))
    return sums.withColumns({"rate": rate, "rtf": F.col("decode_s") / F.greatest("audio_s", F.lit(1e-6))})


def totals(rows: DataFrame, seconds: str, size: str, who: str, *keys: str) -> DataFrame:
    """Hours, gigabytes and distinct names by key; summed as decimals."""
    def exact(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(18,4)"))

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), exact(seconds).cast("double").alias("seconds"), exact(size).cast("double").alias("bytes"), F.countDistinct(who).alias("names"))


def running_best(rows: DataFrame, key: str, step: str, metric: str, patience: int = 3) -> DataFrame:
    """``best`` so far, ``improved`` and ``stop``: no improvement in the last ``patience`` evaluations."""
    w = Window.partitionBy(key).orderBy(step)
    before = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("improved", F.coalesce(F.col(metric) < before, F.lit(True))).withColumn("best", F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    recent = F.max(F.col("improved").cast("int")).over(w.rowsBetween(-(patience - 1), 0))
    return out.withColumn("stop", (recent == 0) & (F.row_number().over(w) > patience))


def agreement(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """How two columns of texts agree, by key."""
    filled = F.trim(F.coalesce(F.col(b), F.lit(""))) != ""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(filled).alias("filled"), F.sum(F.length(b)).alias("chars"), F.count_if(F.col(a) == F.col(b)).alias("same"))
