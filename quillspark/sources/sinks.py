"""Sinks: paired tables, manifests, additive shards and request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def write_pair(rows: DataFrame, path: str, audit_path: str, key: str, audit: list[str]) -> None:
    """The data set and, apart, its audit columns under the same key; maps become JSON at this boundary."""
    maps = {f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() == "map"}
    flat = rows.withColumns(maps) if maps else rows
    flat.drop(*audit).write.mode("overwrite").parquet(path)
    flat.select(key, *audit).write.mode("overwrite").parquet(audit_path)


def append_new(rows: DataFrame, path: str, session: str) -> DataFrame:
    """Append the rows of sessions that the table at ``path`` does not hold yet; returns what was appended."""
    spark: SparkSession = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(session).distinct()
    except Exception as e:  # no table yet; anything else is an error
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = rows if done is None else rows.join(done, session, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def trainer_manifest(rows: DataFrame, path: str, audio: Column, duration: Column, text: Column) -> None:
    rows.select(audio.alias("audio_filepath"), duration.alias("duration"), text.alias("text")).write.mode("overwrite").json(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def chunked_requests(rows: DataFrame, work: str, order: str, size: int, *fields: str) -> DataFrame:
    """(work, chunk, custom_id, n, request): groups of at most ``size`` rows of a work as one JSON request each."""
    w = Window.partitionBy(work).orderBy(order)
    chunk = F.floor((F.row_number().over(w) - 1) / size).cast("long")
    items = F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    out = rows.withColumn("chunk", chunk).groupBy(work, "chunk").agg(F.count("*").alias("n"), items.alias("items"))
    name = F.concat_ws("_", F.col(work).cast("string"), F.col("chunk").cast("string"))
    return out.select(work, "chunk", name.alias("custom_id"), "n", F.to_json(F.struct("items")).alias("request"))


def merge_sidecar(rows: DataFrame, sidecar: DataFrame, key: str, columns: list[str], metadata_only: bool = False) -> DataFrame:
    """Left merge that overwrites only with values; ``metadata_only`` gives the key and the merged columns alone."""
    new = sidecar.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = rows.join(new, key, "left")
    out = out.withColumns({c: F.coalesce(f"_new_{c}", c) if c in rows.columns else F.col(f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns])
    return out.select(key, *columns) if metadata_only else out
