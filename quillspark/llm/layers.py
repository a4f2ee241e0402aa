"""Pareto layers of any number of points, by pivot lattice trees in bounded blocks.

A point's layer is the length of the longest chain of dominating points that ends in it. Levels only ever rise towards it:

* Prune: points are dealt by hash to buckets of a bounded size; a point above the last layer within its bucket is above it
  among all. Survivors are dealt again until a pass drops few.
* Blocks: survivors are cut, in order, into blocks of a bounded size. In each round, rows whose level has just risen raise
  those of the blocks that they can dominate (blocks are compared by the corners of their boxes first), a pair of blocks a
  task; then each block raises its own. It ends when no level rises, after as many rounds as there are layers at most.

No step holds more than two blocks, whatever the number of points, groups or ties; nothing but counts goes to the driver,
and joins merge: a table whose file is small can still be large, so none is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import lattice
from quillspark.operators.scans import ones, running
from quillspark.plans.storage import materialize

#: Points of a bucket while pruning, about, and of a block afterwards, at most.
BUCKET = 32_768
BLOCK = 8_192
#: Pruning goes on while a pass drops more than this share.
SHARE = 0.25
#: The cost of a missing measure: worse than every number, equal to itself.
MISSING = (1 << 63) - 1


def layers(points: DataFrame, group: str, costs: list[str], most: int, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(group, costs, level) of the points in the first ``most`` layers of their group; all others are left out.

    ``points``: distinct rows of a string group and integer costs, none null, the lower the better; a column ``level`` may
    hold lower bounds of the layers. Groups of any size; an empty table gives an empty table.
    """
    key = [group, *costs]
    if "level" not in points.columns:
        points = points.withColumn("level", F.lit(1))
    state = points.select(*key, F.col("level").cast("int").alias("level"))
    before, left = float("inf"), state.count()
    while left < (1 - SHARE) * before:
        state = materialize(_prune(state, group, costs, most, bucket), "pruned")
        before, left = left, state.count()
    state = materialize(_blocks(state, group, costs, most, block), "blocks")
    while state.agg(F.count_if("risen")).first()[0]:
        state = materialize(_round(state, group, costs, most), "levels")
    return state.select(*key, "level")


def _prune(state: DataFrame, group: str, costs: list[str], most: int, bucket: int) -> DataFrame:
    sizes = state.groupBy(group).agg(F.ceil(F.count("*") / bucket).alias("_n"))
    sizes = materialize(sizes, "sizes")  # a side that ends in an exchange of its own: a hot group can be split
    dealt = state.join(sizes.hint("merge"), group).withColumn("_b", F.pmod(F.xxhash64(*costs), F.col("_n")))

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        rows["level"] = lattice.raise_levels(rows[costs].to_numpy(), rows["level"].to_numpy(), most)
        return rows.loc[rows["level"] <= most, [group, *costs, "level"]]

    return dealt.groupBy(group, "_b").applyInPandas(level, state.schema)


def _blocks(state: DataFrame, group: str, costs: list[str], most: int, block: int) -> DataFrame:
    """State with a block of rows that are neighbours in order, and levels raised within it; all rows count as risen.

    Blocks come from the rows' numbers, so that they are alike for any number of tasks.
    """
    key = [group, *costs]
    numbered = running(state.select(*key, "level"), [], key, ones("_number"), {"_number": 0})

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows["level"] = lattice.raise_levels(rows[costs].to_numpy(), rows["level"].to_numpy(), most)
        rows["risen"] = True
        return rows.loc[rows["level"] <= most, [*key, "level", "block", "risen"]]

    schema = ", ".join([f"`{group}` string", *(f"`{c}` long" for c in costs), "level int, block long, risen boolean"])
    cut = numbered.withColumn("block", F.floor((F.col("_number") - 1) / block)).drop("_number")
    # Where a block holds the end of one group and the start of another, each part is a block of the same number.
    return cut.groupBy(group, "block").applyInPandas(settle, schema)


def _round(state: DataFrame, group: str, costs: list[str], most: int) -> DataFrame:
    key = [group, *costs]
    box = [f(c).alias(f"_{side}_{c}") for c in costs for side, f in (("low", F.min), ("high", F.max))]
    targets = state.groupBy(group, F.col("block").alias("_to")).agg(*box, F.min("level").alias("_least"))
    sources = state.filter("risen").groupBy(F.col(group).alias("_group"), F.col("block").alias("_from")).agg(*[F.min(c).alias(f"_best_{c}") for c in costs], F.max("level").alias("_top"))
    reach = [F.col(f"_best_{c}") <= F.col(f"_high_{c}") for c in costs]
    meets = (F.col(group) == F.col("_group")) & (F.col("_from") != F.col("_to")) & (F.col("_top") >= F.col("_least"))
    for r in reach:
        meets &= r
    pairs = materialize(targets.join(sources.hint("merge"), meets).select(F.col(group).alias("_of"), "_from", "_to"), "pairs")

    def rows(side: str, chosen: DataFrame) -> DataFrame:
        found = chosen.join(pairs.hint("merge"), (F.col(group) == F.col("_of")) & (F.col("block") == F.col(side))).select("_from", "_to", "block", *key, "level")
        return found.toDF(*[f"{c}{side}" for c in found.columns])  # names that the two sides do not share

    def lift(ups: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ups, own = (x.rename(columns=lambda c, side=side: c.removesuffix(side)) for x, side in ((ups, "_from"), (own, "_to")))
        was = own["level"].to_numpy()
        if len(ups) and len(own):
            own["level"] = lattice.raise_from(ups[costs].to_numpy(), ups["level"].to_numpy(), own[costs].to_numpy(), was, most)
        return own.loc[own["level"].to_numpy() > was, ["block", *key, "level"]]

    schema = state.select("block", *key, "level").schema
    sides = [rows("_from", state.filter("risen")).groupBy(f"{group}_from", "_from_from", "_to_from"), rows("_to", state).groupBy(f"{group}_to", "_from_to", "_to_to")]
    lifted = sides[0].cogroup(sides[1]).applyInPandas(lift, schema).groupBy("block", *key).agg(F.max("level").alias("level"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby(key, sort=False, as_index=False).agg(level=("level", "max"), _was=("level", "min"), block=("block", "first"))
        if (rows["level"] > rows["_was"]).any():
            rows["level"] = lattice.raise_levels(rows[costs].to_numpy(), rows["level"].to_numpy(), most)
        rows["risen"] = rows["level"] > rows["_was"]
        return rows.loc[rows["level"] <= most, [*key, "level", "block", "risen"]]

    return state.select("block", *key, "level").unionByName(lifted).groupBy(group, "block").applyInPandas(settle, state.schema)


def floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) of integers, exactly; null where b is 0."""
    a, b = F.when(b < 0, -a).otherwise(a), F.when(b != 0, F.abs(b))
    r = F.pmod(a, b)
    return F.call_function("div", a - r, b)


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; values that are no finite numbers count as missing."""
    x = x.cast("double")
    return F.when(F.abs(x) < 1e14, F.floor(100 * x + 0.5))


MEASURES = ["price", "discount", "delay", "quantity"]


def offers(lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, vendor_id, part_type, price, discount, delay, quantity): a row per pair of item and vendor with lines.

    Sums are of integers, so that the order of rows changes nothing. Lines without item or vendor are left out; repeated
    lines all count; each measure skips lines that lack one of its inputs and is null if none is left. A sale or an item that
    the other tables lack, or without the needed value, is such an input. Of a repeated sale_id the earliest time holds,
    of a repeated item_id the least price and the least kind.
    """
    day = materialize(sales.filter("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("_sale")).agg(F.to_date(F.min("sold_at")).alias("_sold")), "sales")
    item = materialize(items.filter("item_id IS NOT NULL").groupBy(F.col("item_id").alias("_item")).agg(cents(F.min("price")).alias("_p"), F.min("kind").alias("part_type")), "items")
    used = lines.filter("item_id IS NOT NULL AND vendor_id IS NOT NULL")
    used = used.select("sale_id", "item_id", "vendor_id", F.col("quantity").cast("long").alias("quantity"), cents(F.col("amount")).alias("_c"), cents(F.col("discount")).alias("_d"), F.to_date("shipped_at").alias("_shipped"))
    used = used.join(day.hint("merge"), F.col("sale_id") == F.col("_sale"), "left")
    days = F.datediff("_shipped", "_sold").cast("long")
    priced = F.col("_c").isNotNull() & F.col("_d").isNotNull() & F.col("quantity").isNotNull()
    summed = used.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(priced, F.col("_c") * (100 - F.col("_d")))).alias("_paid"), F.sum(F.when(priced, F.col("quantity"))).alias("_pieces"),
        F.sum("_d").alias("_d"), F.count("_d").alias("_n_d"), F.sum(days).alias("_days"), F.count(days).alias("_n_days"), F.max("quantity").alias("quantity"),
    )
    found = summed.join(item.hint("merge"), F.col("item_id") == F.col("_item"), "left")
    return found.select(
        "item_id", "vendor_id", "part_type", F.when(F.col("_p") >= 1, floor_div(F.col("_paid"), F.col("_p") * F.col("_pieces"))).alias("price"),
        floor_div(F.col("_d"), F.col("_n_d")).alias("discount"), floor_div(F.col("_days"), F.col("_n_days")).alias("delay"), "quantity",
    )


def pareto_layers(rows: DataFrame, type_col: str, lower: list[str], higher: list[str], most: int = 24, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """``rows`` with type_layer, global_layer and n_equal over integer measures, of which the lower or the higher are better.

    A row dominates another if no measure is worse and one is better; null is worse than numbers and equal to null. Rows that
    none dominates form layer 1, and so on with the rest; layers beyond ``most`` are 0. type_layer counts rows of the same
    type only (nulls form one type), global_layer all. n_equal: rows of any type with the same measures, the row included.
    Repeated rows stay and share a layer; an empty table gives an empty one. Other columns stay as
    they are, but for such named like results; names that begin with __l_ are the operator's own.
    """
    rows = rows.drop("type_layer", "global_layer", "n_equal")
    costs = [f"__l_cost{k}" for k in range(len(lower) + len(higher))]
    values = [*(F.col(c).cast("long") for c in lower), *(-F.col(c).cast("long") for c in higher)]
    group = F.coalesce(F.concat(F.lit("t"), F.col(type_col).cast("string")), F.lit("none"))
    rows = materialize(rows.withColumns({"__l_type": group, **{c: F.coalesce(v, F.lit(MISSING)) for c, v in zip(costs, values, strict=True)}}), "rows")
    points = materialize(rows.groupBy("__l_type", *costs).agg(F.count("*").alias("__l_n")), "points")
    typed = layers(points.select("__l_type", *costs), "__l_type", costs, most, bucket, block)
    # Dominators within a type are dominators among all: what is above the last layer of its type is above it among all.
    start = typed.groupBy(*costs).agg(F.max("level").alias("level")).withColumn("__l_type", F.lit("all"))
    overall = layers(materialize(start, "start"), "__l_type", costs, most, bucket, block).select(*costs, F.col("level").alias("global_layer"))
    equal = points.groupBy(*costs).agg(F.sum("__l_n").alias("n_equal")).join(overall.hint("merge"), costs, "left")
    found = points.join(typed.withColumnRenamed("level", "type_layer").hint("merge"), ["__l_type", *costs], "left").join(equal.hint("merge"), costs)
    zero = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("type_layer", "global_layer")}
    found = materialize(found.drop("__l_n").withColumns(zero), "layers")
    return rows.join(found.hint("merge"), ["__l_type", *costs]).drop("__l_type", *costs)
