"""Running sums over ordered rows of any number, also within keys that fill many tasks.

Rows are dealt to ranges of (key, order); each task sums its own range with numpy and notes what it ends with; the sums that
a range's first key has in earlier ranges, one row a task, are joined back. No key or order goes through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.plans.storage import materialize


def running(rows: DataFrame, key: list[str], order: list[str], terms: Callable[[pa.Table], dict[str, np.ndarray]], modulus: dict[str, int]) -> DataFrame:
    """``rows`` with, for each name of ``modulus``, the sum of its term over the rows of the key up to and with this one.

    ``key``: columns of longs without nulls, none for sums over everything. ``order``: columns that order a key's rows
    (ascending, nulls first); ties are summed in any order. ``terms`` gives the int64 terms of a batch, at least 0 and, where
    there is a modulus (not 0), below it; a modulus is below 2**32. Repeated rows all count; an empty table stays empty.
    """
    added_fields = [T.StructField(name, T.LongType()) for name in ("__s_part", *modulus)]
    schema = T.StructType([*rows.schema.fields, *added_fields, T.StructField("__s_head", T.BooleanType()), T.StructField("__s_tail", T.BooleanType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head, sums, held = TaskContext.get().partitionId(), None, True, dict.fromkeys(modulus, 0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key], axis=1) if key else np.zeros((n, 1), np.int64)
            new = np.r_[last is not None and (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1)]
            starts = np.flatnonzero(new)
            added = []
            for name, term in terms(pa.Table.from_batches([batch])).items():
                total = np.cumsum(term, dtype=np.int64)
                before = np.r_[sums[name], np.zeros(len(starts), np.int64)]
                before[1:] = -(total[starts] - term[starts])
                total += before[np.cumsum(new)]
                if modulus[name]:
                    total %= modulus[name]
                sums[name] = int(total[-1])
                added.append(pa.array(total))
            heads = np.full(n, head)
            if len(starts):
                heads[starts[0] :] = head = False
            tail, last = np.zeros(n, bool), keys[-1]
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), *added, pa.array(heads), pa.array(tail)], names=schema.names)
        if held is not None:
            tail = np.zeros(held.num_rows, bool)
            tail[-1] = True
            yield held.set_column(len(schema.names) - 1, "__s_tail", pa.array(tail))

    by = [*key, *order]
    dealt = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(local, schema), "ranges")
    # A range's first key gets what earlier ranges end with of that key.
    ends = dealt.filter("__s_tail").select("__s_part", *key, *modulus, F.lit(1).alias("__s_end"))
    begins = dealt.filter("__s_head").select("__s_part", *key).distinct().select("*", *[F.lit(0).cast("long").alias(m) for m in modulus], F.lit(0).alias("__s_end"))
    earlier = Window.partitionBy(*key).orderBy("__s_part", "__s_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(begins).select("__s_part", "__s_end", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"__s_{m}") for m in modulus]).filter("__s_end = 0").drop("__s_end")
    found = dealt.join(F.broadcast(carried), "__s_part", "left")  # one row a task of the exchange
    return found.select(*rows.columns, *[_plus(F.col(m), F.when(F.col("__s_head"), F.col(f"__s_{m}")).otherwise(0), modulus[m]).alias(m) for m in modulus])


def _plus(a, b, modulus: int):
    return F.pmod(a + b, F.lit(modulus)) if modulus else a + b


def ones(name: str) -> Callable[[pa.Table], dict[str, np.ndarray]]:
    """Terms that count rows."""
    return lambda t: {name: np.ones(t.num_rows, np.int64)}
