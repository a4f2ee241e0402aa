"""The training fold and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id is held out too: it has no fold to learn from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def bounded_sample(rows: DataFrame, id_col: str, bound: int, seed: int = 17) -> DataFrame:
    """All rows if they are at most ``bound``; else about ``bound`` of them, by a hash of the id."""
    n = rows.count()
    if n <= bound:
        return rows
    share = int(bound / n * (1 << 20))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 20)) < share)
