"""Versions of a table with a keyed merge, and hub shards with retries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.sources import shards, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_rows(spark):
    current = spark.createDataFrame([(1, "error", "a", 9), (1, "error", "b", 9), (2, "ok", "c", 9), (3, None, "d", 9), (None, "error", "e", 9)], "id long, state string, text string, other long")
    changes = spark.createDataFrame([(1, 5, "fixed", "late"), (1, 2, "fixed", "early"), (2, 1, "fixed", "x"), (7, 1, "new", None), (None, 1, "fixed", "n"), (3, None, "fixed", "y")], "id long, seq long, state string, text string")
    salvaged = snapshots.merge_rows(current, changes, "id", ["seq"], when=F.col("state") == "error")
    assert rows(salvaged) == rows(spark.createDataFrame([(1, "fixed", "late", 9), (1, "fixed", "late", 9), (2, "ok", "c", 9), (3, None, "d", 9), (None, "error", "e", 9)], current.schema))
    merged = snapshots.merge_rows(current, changes, "id", ["seq"], add=True)
    assert rows(merged) == rows(spark.createDataFrame([(1, "fixed", "late", 9), (1, "fixed", "late", 9), (2, "fixed", "x", 9), (3, "fixed", "y", 9), (None, "error", "e", 9), (7, "new", None, None)], current.schema))
    assert rows(snapshots.merge_rows(current, changes.limit(0), "id", ["seq"], add=True)) == rows(current)
    assert snapshots.merge_rows(current.limit(0), changes, "id", ["seq"]).count() == 0


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.publish(spark.range(3), path) == 1
    assert snapshots.publish(snapshots.read(spark, path).filter("id > 0"), path) == 2  # reads what it replaces
    assert rows(snapshots.read(spark, path)) == [(1,), (2,)] and rows(snapshots.read(spark, path, 1)) == [(0,), (1,), (2,)]
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(broken, path)
    assert snapshots.version(spark, path) == 2 and rows(snapshots.read(spark, path)) == [(1,), (2,)]
    assert snapshots.publish(spark.range(1), path, base=2) == 3
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(9), path, base=2)
    assert rows(snapshots.read(spark, path)) == [(0,)]


def test_retries_wait_longer_each_time():
    waits, left = [], [OSError("a"), OSError("b")]

    def call():
        if left:
            raise left.pop()
        return b"x"

    assert shards.with_retries(call, 3, 0.5, waits.append) == b"x" and waits == [0.5, 1.0]
    left.extend([OSError("a"), OSError("b")])
    with pytest.raises(OSError):
        shards.with_retries(call, 2, 0.5, waits.append)


def test_hub_shards(spark, tmp_path):
    for k, part in enumerate([[1, 2], [3], []]):
        pq.write_table(pa.table({"id": pa.array(part, pa.int32()), "text": pa.array([f"t{x}" for x in part]), "audio": pa.array([b"x"] * len(part), pa.binary())}), tmp_path / f"train-{k:05d}-of-00003.parquet")
    (tmp_path / "splits.json").write_text('{"train": 3, "test": 0}')
    # A reader that fails twice for each address; the count lies in files, as tasks run in other processes.
    (tmp_path / "flaky_reader.py").write_text(
        "import os\n\ndef fetch(address):\n    mark = address + '.tries'\n    n = os.path.getsize(mark) if os.path.exists(mark) else 0\n"
        "    open(mark, 'ab').write(b'x')\n    if n < 2:\n        raise ConnectionError(address)\n    return open(address, 'rb').read()\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "flaky_reader.py"))
    spark.dataSource.register(shards.HubShards)
    hub = spark.read.format("hub_shards").schema("id long, text string, extra double").option("root", str(tmp_path)).option("backoff_s", 0.01)
    plain = hub.load()
    assert rows(plain) == [(1, "t1", None), (2, "t2", None), (3, "t3", None)] and plain.rdd.getNumPartitions() == 3
    flaky = hub.option("fetch", "flaky_reader:fetch").option("shards", 3)
    assert rows(flaky.load()) == rows(plain)
    with pytest.raises(Exception, match="no split dev"):
        spark.read.format("hub_shards").schema("id long").option("root", str(tmp_path)).option("split", "dev").load().count()
    for f in tmp_path.glob("*.tries"):
        f.unlink()
    with pytest.raises(Exception, match="ConnectionError"):
        flaky.option("tries", 2).load().count()
