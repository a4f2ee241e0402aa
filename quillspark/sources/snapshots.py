"""Versions of a table: each is written whole beside the others and becomes the current one in a single step.

A table's folder holds ``data/<id>`` with the files of a version, and ``commits/<number>`` with the id of the version of that
number.  A commit is a rename that never replaces a file, so readers see the old version or the new one, a failed write
changes nothing, and of two writers that started from the same version one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published in the meantime."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The number of the current version; 0 if there is none."""
    _, at, files = _files(spark, f"{path}/commits")
    if not files.exists(at):
        return 0
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current version, or that of a number."""
    number = version(spark, path) if number is None else number
    if number < 1:
        raise FileNotFoundError(f"no version at {path}")
    name = spark.read.text(f"{path}/commits/{number:010d}").first()[0]
    return spark.read.parquet(f"{path}/data/{name}")


def publish(rows: DataFrame, path: str, base: int | None = None) -> int:
    """Write ``rows`` as the version after ``base`` (by default the current one) and make it current; gives its number."""
    spark = rows.sparkSession
    base, name = version(spark, path) if base is None else base, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{name}")
    jvm, folder, files = _files(spark, f"{path}/commits")
    files.mkdirs(folder)
    draft, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{n}") for n in (f"_{name}", f"{base + 1:010d}"))
    out = files.create(draft)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {base + 1} of {path} exists") from e
        raise
    return base + 1


def merge_rows(current: DataFrame, changes: DataFrame, key: str, order: list[str], when: Column | None = None, add: bool = False) -> DataFrame:
    """``current`` with the columns of ``changes`` (which it has too) taken from the last change of the row's key.

    Of several changes of a key the last in ``order`` (nulls first) holds; only rows of ``current`` for which ``when`` holds
    are changed, which salvages those that need it and leaves the rest.  ``add``: keys that ``current`` lacks become rows,
    with nulls in other columns.  Repeated rows of ``current`` are all changed; rows or changes without a key stay as they
    are or change nothing.  A null in the last change is its value.  Columns of ``order`` that ``current`` lacks are dropped.
    """
    names = [c for c in changes.columns if c in current.columns and c != key]
    last = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order, F.struct(*names).alias("_new"))).alias("_last"))
    last = last.select("_key", F.col("_last._new").alias("_new"), F.lit(True).alias("_is"))
    hit = F.col("_is") & (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    out = current.join(last, F.col(key) == F.col("_key"), "left").select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else c for c in current.columns])
    if not add:
        return out
    fresh = last.join(current.select(F.col(key).alias("_have")).distinct(), F.col("_key") == F.col("_have"), "left_anti")
    return out.unionByName(fresh.select(F.col("_key").alias(key), *[F.col(f"_new.{c}").alias(c) for c in names]), allowMissingColumns=True)
