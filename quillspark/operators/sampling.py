"""Budgets, quotas, splits and mixes.

Random order is a hash of seed and id, the same in every run and engine.  Orders within a group use windows partitioned
by the group; orders over everything go through ``running_total``, which sums partitions first and never sorts all rows
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.storage import materialize

#: Groups up to which their splits are broadcast; beyond, the join shuffles.
BROADCAST_GROUPS = 100_000


def hash_order(id_: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string")).cast("binary"))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def running_total(rows: DataFrame, order: list[str], amount: str, out: str = "before", ranges: int | None = None) -> DataFrame:
    """``out``: the sum of ``amount`` over all rows before this one in a total order.

    Rows are dealt to ranges of the order (as many as the session's shuffle partitions, unless given) and written with the
    range's number, so that a lost executor changes no range; each is summed on its own, and the ranges' offsets, one row a
    range, are joined back.
    """
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    offsets = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    offsets = offsets.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_offset"))  # one row a range
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(amount).over(within), F.lit(0).cast(rows.schema[amount].dataType)) + F.col("_offset")
    return dealt.join(F.broadcast(offsets), "_part").withColumn(out, before).drop("_part", "_offset")


def budget_prefix(rows: DataFrame, order: list[str], amount: str, target, group: list[str] | None = None) -> DataFrame:
    """Rows in order until the budget is reached, the crossing row included; rows without an amount are skipped."""
    used = rows.filter(F.col(amount) > 0)
    if group:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        summed = used.withColumn("before", F.coalesce(F.sum(amount).over(w), F.lit(0).cast(rows.schema[amount].dataType)))
    else:
        summed = running_total(used, order, amount)
    return summed.filter(F.col("before") < target).drop("before")


def round_robin(rows: DataFrame, group: str, order: list, target: int, group_order: str | None = None) -> DataFrame:
    """Rows taken in turns, one from each group in the group's order, until there are ``target``; ``turn`` is the round."""
    w = Window.partitionBy(group).orderBy(*order)
    turns = rows.withColumn("turn", F.row_number().over(w)).withColumn("_one", F.lit(1).cast("long")).filter(F.col("turn") <= target)
    return running_total(turns, ["turn", group_order or group], "_one").filter(F.col("before") < target).drop("_one", "before")


def chant_quota(rows: DataFrame, flag: str, session: str, id_: str, target: int = 800, least: int = 1, most: int = 10, seed: int = 42) -> DataFrame:
    """All rows without the flag, and flagged ones up to a cap per session and, in turns, a global target."""
    plain, chants = rows.filter(~F.coalesce(F.col(flag), F.lit(False))), rows.filter(F.col(flag))
    sessions = chants.select(session).distinct().count()
    cap = max(least, min(most, -(-target // max(sessions, 1))))
    w = Window.partitionBy(session).orderBy(hash_order(F.col(id_), seed), id_)
    capped = chants.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")
    return plain.unionByName(round_robin(capped.withColumn("_h", hash_order(F.col(id_), seed)), session, ["_h", id_], target).drop("turn", "_h"))


def first_per_group(rows: DataFrame, group: list[str], flag: str, order: str, most: int = 2) -> DataFrame:
    """All rows without the flag; of flagged ones the first ``most`` of each group."""
    w = Window.partitionBy(*group, flag).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(~F.col(flag) | (F.col("_r") <= most)).drop("_r")


def offset_split(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """``split``: 'val' for the rows from offset to offset + size in a total order, else 'train'; disjoint and exhaustive."""
    one = running_total(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_at")
    return one.withColumn("split", F.when((F.col("_at") >= offset) & (F.col("_at") < offset + size), "val").otherwise("train")).drop("_one", "_at")


def group_disjoint_split(rows: DataFrame, group: str, id_: str, sizes: dict[str, int]) -> DataFrame:
    """``split``: whole groups, smallest first, fill each named split up to its size (trimmed); other groups are 'train'.

    A row of a held-out group beyond the size is 'dropped', so no group is in two splits.  Groups are few against rows; their
    running sum runs over one row a group.
    """
    groups = rows.groupBy(group).agg(F.count("*").alias("_n"))
    groups = running_total(groups, ["_n", group], "_n", "_before")
    # A split starts with the first group after the one in which its predecessor's size was reached.
    out, start = groups.withColumn("split", F.lit("train")), 0
    for name, size in sizes.items():
        begin = groups.filter(F.col("_before") >= start).agg(F.min("_before")).first()[0]
        if begin is None:
            break
        out = out.withColumn("split", F.when((F.col("_before") >= begin) & (F.col("_before") < begin + size), name).otherwise(F.col("split")))
        start = begin + size
    side = out.select(group, "split")
    labelled = rows.join(F.broadcast(side) if groups.count() <= BROADCAST_GROUPS else side, group)
    held = labelled.filter("split <> 'train'")
    trimmed = running_total(held.withColumn("_one", F.lit(1).cast("long")), ["split", group, id_], "_one", "_at")
    limit = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])[F.col("split")]
    starts = trimmed.groupBy("split").agg(F.min("_at").alias("_from"))
    trimmed = trimmed.join(F.broadcast(starts), "split").withColumn("split", F.when(F.col("_at") - F.col("_from") < limit, F.col("split")).otherwise("dropped"))
    return labelled.filter("split = 'train'").unionByName(trimmed.select(*labelled.columns))


def capped_halves(rows: DataFrame, group: str, id_: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows a group, in hash order, dealt to 'eval' and 'test' in turns."""
    w = Window.partitionBy(group).orderBy(hash_order(F.col(id_), seed), id_)
    out = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    return out.withColumn("split", F.when(F.col("_r") % 2 == 1, "eval").otherwise("test")).drop("_r")


def oversample(rows: DataFrame, minority: Column, share: float, id_: str) -> DataFrame:
    """Repeat the minority so that it is ``share`` of the whole: whole copies and the first rows (by id) once more."""
    n_major, n_minor = rows.agg(F.count_if(~minority), F.count_if(minority)).first()
    target = int(n_major * share / (1 - share))
    copies, rest = divmod(target, n_minor) if n_minor and target > n_minor else (1, 0)
    minor = running_total(rows.filter(minority).withColumn("_one", F.lit(1).cast("long")), [id_], "_one", "_at").drop("_one")
    times = F.lit(copies) + F.when(F.col("_at") < rest, 1).otherwise(0)
    repeated = minor.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_at")
    return rows.filter(~minority).withColumn("copy", F.lit(1)).unionByName(repeated)


def repeat_mix(rows: DataFrame, weights: Column) -> DataFrame:
    """Each row as often as its weight says; ``copy`` numbers them."""
    return rows.filter(weights > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), weights)))


def interleave(a: DataFrame, b: DataFrame, share: float, id_: str, seed: int = 42) -> DataFrame:
    """A probabilistic mix of two sources by hash thresholds: ``share`` of a's rows, the rest of b's."""
    unit = F.conv(F.substring(hash_order(F.col(id_), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return a.filter(unit < share).unionByName(b.filter(unit >= share))


def hash_split(rows: DataFrame, id_: str, n_test: int, seed: int = 42) -> DataFrame:
    """``split``: the ``n_test`` first rows in hash order are 'test'."""
    keyed = rows.withColumn("_h", hash_order(F.col(id_), seed)).withColumn("_one", F.lit(1).cast("long"))
    out = running_total(keyed, ["_h", id_], "_one", "_at")
    return out.withColumn("split", F.when(F.col("_at") < n_test, "test").otherwise("train")).drop("_h", "_one", "_at")


def sample_per_class(rows: DataFrame, class_: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(class_).orderBy(hash_order(F.col(id_), seed), id_)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def map_distinct(rows: DataFrame, key: str, compute) -> DataFrame:
    """Compute once per distinct key and join the result back to every row with it."""
    return rows.join(compute(rows.select(key).distinct()), key, "left")


def leak_audit(train: DataFrame, evals: DataFrame, id_: str, name: str) -> DataFrame:
    """(eval_set, n_eval, n_leaked, safe): distinct ids of each evaluation set that training holds too."""
    leaked = train.select(F.col(id_).alias("_t")).distinct()
    both = evals.select(name, id_).distinct().join(leaked, F.col(id_) == F.col("_t"), "left")
    out = both.groupBy(F.col(name).alias("eval_set")).agg(F.count("*").alias("n_eval"), F.count("_t").alias("n_leaked"))
    return out.withColumn("safe", F.col("n_leaked") == 0)
