"""Shards of near equal size from ordered atomic groups: a contiguous partition of least largest shard.

Groups of equal texts are put in order; a running sum of their sizes gives the places where a cut is allowed. The smallest
capacity for which filling shards greedily needs no more than the given number is found by binary search, and the cuts are
made at that capacity. All this asks only for the places next to some points, so the driver needs no list of the groups: it
holds a bounded skeleton of places and notes the gaps of the skeleton that an answer fell into; the cluster then looks into
those gaps, until no answer depends on a gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scans import ones, running
from quillspark.plans.storage import materialize

#: Places that one round brings to the driver, about.
PLACES = 65_536


class Skeleton:
    """Known places of cuts, and how many there are between neighbours that are not known.

    ``touched``: the gaps with hidden places that an answer depended on. While it is empty, all answers are exact.
    """

    def __init__(self, total: int, groups: int):
        self.places, self.hidden = np.array([0, total], np.int64), np.array([groups - 1, 0], np.int64)
        self.touched: set[int] = set()

    def last(self, x: int) -> int:
        """The last place up to x."""
        at = int(np.searchsorted(self.places, x, "right")) - 1
        if self.hidden[at]:
            self.touched.add(at)
        return int(self.places[at])

    def first(self, x: int) -> int:
        """The first place from x on; 0 and the end are places."""
        at = int(np.searchsorted(self.places, x, "left"))
        if at == 0 or self.places[at] == x:
            return int(self.places[at])
        if self.hidden[at - 1]:
            self.touched.add(at - 1)
        return int(self.places[at])

    def add(self, places: np.ndarray, counts: np.ndarray) -> None:
        """New places with the number of places behind the previous known one up to them."""
        hidden = dict(zip(self.places.tolist(), self.hidden.tolist(), strict=True))
        both = np.union1d(self.places, places)
        for place, n in zip(places.tolist(), counts.tolist(), strict=True):
            before = int(both[np.searchsorted(both, place) - 1])
            at = int(self.places[np.searchsorted(self.places, place, "right") - 1])
            hidden[at] -= n
            hidden[before] = hidden.get(before, 0) + n - 1
        self.places, self.hidden, self.touched = both, np.array([hidden.get(p, 0) for p in both.tolist()], np.int64), set()


def feasible(known: Skeleton, capacity: int, shards: int, total: int) -> bool:
    """Whether greedy filling, each shard as far as the capacity reaches, gets to the end."""
    at = 0
    for _ in range(shards):
        at = known.last(at + capacity)
        if at >= total:
            return True
    return False


def plan(known: Skeleton, shards: int, total: int, largest: int) -> list[int]:
    """Ends of the shards: the smallest feasible capacity by binary search, then cuts that it allows.

    Of the cuts that keep every shard within the capacity, each is the one nearest to an equal share of what is left (the
    earlier of two as near), not before the earliest from which the rest still fits.
    """
    low, high = max(largest, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if feasible(known, middle, shards, total):
            high = middle
        else:
            low = middle + 1
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(known.first(max(earliest[-1] - low, 0)))
    at, ends = 0, []
    for j in range(1, shards):
        need, share = earliest[shards - j], at + (total - at) // (shards - j + 1)
        under, over = known.last(min(share, at + low)), known.first(share)
        best = over if over <= at + low and over - share < share - under else under
        at = max(best, need)
        ends.append(at)
    return [*ends, total]


def cuts(ends: DataFrame, end: str, shards: int, total: int, groups: int, largest: int, places: int = PLACES) -> list[int]:
    """The ends of the shards. ``ends``: a row per group with the running sum ``end``."""
    if not total:
        return []
    known = Skeleton(total, groups)
    while True:
        found = plan(known, shards, total, largest)
        if not known.touched:
            return found
        gaps = np.array(sorted(known.touched))
        more = _places(ends, end, known.places[gaps], known.places[gaps + 1], max(2, places // len(gaps))).toPandas().sort_values("end")
        known.add(more["end"].to_numpy(np.int64), more["n"].to_numpy(np.int64))


def _places(ends: DataFrame, end: str, low: np.ndarray, high: np.ndarray, parts: int) -> DataFrame:
    """(end, n): each gap between low and high cut into equal parts, and of each part the last place and how many there are."""
    width = np.maximum(-(-(high - low) // parts), 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            gap = np.searchsorted(low, x, "left") - 1  # the last gap that begins before x
            inside = (gap >= 0) & (x < high[gap])
            yield pa.RecordBatch.from_arrays([pa.array(gap[inside]), pa.array((x[inside] - low[gap[inside]]) // width[gap[inside]]), pa.array(x[inside])], names=["gap", "part", "end"])

    return ends.select(end).mapInArrow(part, "gap long, part long, end long").groupBy("gap", "part").agg(F.max("end").alias("end"), F.count("*").alias("n"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES) -> DataFrame:
    """A row per input row: id_col, size, text_crc32, group_id, shard and slot.

    size: UTF-8 bytes of the text (null: none) and 8 for the id. A group holds the rows of equal texts (a null text counts
    as an empty one), group_id is its smallest id; groups are in the order of group_id, a null id first. Shards are runs of
    whole groups such that the largest shard is as small as possible, and near an equal share where that leaves a choice;
    groups as large as the share of a shard come first, each in a shard of its own. Shards may stay empty if groups are few.
    slot numbers a shard's rows by group and id from 0, repeated rows in any order. An empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows without an id keep a place in the order: below all ids that a table can have but its least.
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("_id"), number.alias("_number"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_text"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("_text").agg(F.min("_number").alias("_group"), F.sum("size").alias("_size")), "groups")
    left, n = groups.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    top, own = groups.orderBy(F.desc("_size"), "_group").limit(shards).collect(), []
    while len(own) < len(top) and top[len(own)]["_size"] * (shards - len(own)) >= left:
        left -= top[len(own)]["_size"]
        own.append(top[len(own)])
    alone = F.lit(None).cast("int")  # at most one comparison per shard
    for k, row in enumerate(own):
        alone = F.when(F.col("_text") == F.lit(bytes(row["_text"])), k).otherwise(alone)
    groups = groups.withColumn("_alone", alone)
    rest = running(groups.filter("_alone IS NULL"), [], ["_group"], lambda t: {"_end": t.column("_size").to_numpy()}, {"_end": 0})
    at = cuts(rest, "_end", shards - len(own), left, n - len(own), top[len(own)]["_size"] if len(own) < len(top) else 0, places)
    place = sum(((F.col("_end") > c).cast("int") for c in at[:-1]), F.lit(len(own)))
    placed = rest.select("_text", "_group", place.alias("shard")).unionByName(groups.filter("_alone IS NOT NULL").select("_text", "_group", F.col("_alone").alias("shard")))
    placed = materialize(placed.withColumnRenamed("_text", "_key"), "placed")
    rows = rows.join(placed, F.col("_text") == F.col("_key")).select("_id", "_number", "size", "text_crc32", "_group", F.col("shard").cast("long").alias("shard"))
    rows = running(rows, ["shard"], ["_group", "_number"], ones("slot"), {"slot": 0})
    group = F.when(F.col("_group") > -(1 << 63), F.col("_group"))
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", group.alias("group_id"), F.col("shard").cast("int").alias("shard"), (F.col("slot") - 1).alias("slot"))
