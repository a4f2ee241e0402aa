"""A hub of data sets as a Spark data source: named splits in numbered Parquet shards, a partition each, fetched with retries.

    spark.dataSource.register(HubShards)
    spark.read.format("hub_shards").schema("id long, text string").option("root", ...).option("split", "train").load()

``root`` is a folder or address below which ``<split>-00000-of-00003.parquet`` lie, ``shards`` their number (default: read
from ``<root>/splits.json``, {"train": 3}).  ``fetch`` names a function ``module:function`` from an address to bytes; the default reads files.
A shard is fetched in its own task; one that fails is tried again after ``backoff_s``, twice that, and so on, ``tries`` times
in all.  Columns that a shard lacks are null, those that the schema lacks are not returned.
"""

from __future__ import annotations

import importlib
import io
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read_file(address: str) -> bytes:
    with open(address.removeprefix("file://"), "rb") as f:
        return f.read()


def with_retries(call: Callable[[], bytes], tries: int, backoff_s: float, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The call's value; after a failure it is made again, each time after twice the wait, until ``tries`` are used up."""
    for k in range(tries):
        try:
            return call()
        except FileNotFoundError:
            raise  # will not come by waiting
        except Exception:
            if k + 1 == tries:
                raise
            wait(backoff_s * 2**k)
    raise ValueError("tries must be at least 1")


class Shard(InputPartition):
    def __init__(self, address: str):
        self.address = address


class HubReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = to_arrow_schema(schema)
        self.root, self.split = options["root"].rstrip("/"), options.get("split", "train")
        self.shards = int(options["shards"]) if "shards" in options else None
        self.fetch, self.tries, self.backoff_s = options.get("fetch"), int(options.get("tries", 5)), float(options.get("backoff_s", 1.0))

    def _get(self, address: str) -> bytes:
        module, _, name = (self.fetch or f"{__name__}:read_file").partition(":")
        call = getattr(importlib.import_module(module), name)
        return with_retries(lambda: call(address), self.tries, self.backoff_s)

    def partitions(self) -> list[Shard]:
        n = self.shards
        if n is None:
            splits = json.loads(self._get(f"{self.root}/splits.json"))
            if self.split not in splits:
                raise ValueError(f"no split {self.split}; there are {sorted(splits)}")
            n = int(splits[self.split])
        return [Shard(f"{self.root}/{self.split}-{k:05d}-of-{n:05d}.parquet") for k in range(n)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(io.BytesIO(self._get(partition.address)))
        have = set(file.schema_arrow.names)
        for batch in file.iter_batches(columns=[n for n in self.schema.names if n in have]):
            columns = [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in self.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class HubShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hub_shards"

    def schema(self) -> str:
        raise ValueError("give the schema of a hub's data set with .schema(...)")

    def reader(self, schema: StructType) -> HubReader:
        return HubReader(schema, self.options)
