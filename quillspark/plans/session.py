"""Session construction and the settings every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Runtime settings that the operators assume; a cluster may override all but the first two.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "quillspark") -> SparkSession:
    """A local session for tests and benches; on a cluster spark-submit supplies the master."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.host", os.environ.get("SPARK_LOCAL_IP", "127.0.0.1"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables below ``sf_dir``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
