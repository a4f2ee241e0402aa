"""The prefix trie of conversations, of any number, length and breadth.

Turns get hashes; numpy scans turn them into polynomial rolling fingerprints of every prefix, modulo two primes, also where a
conversation fills several tasks. Equal depth and fingerprint make a candidate group. Every row of a group is compared with
its representative, the row of the smallest id: role, text and the group of the prefix before it. If one differs, all rows
get a further fingerprint of another base and other hashes, which splits the group, until no row differs.

Sums over subtrees double their reach in each round: a node's sum of the levels within 2**k below it, added to its ancestor
2**k above, makes the sum within 2**(k+1); the rounds are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scans import ones, running
from quillspark.plans.storage import materialize

#: Moduli of the fingerprints: primes below 2**31, so that products fit into 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Ids that one row of a list to be hashed holds at most.
IDS = 4096


def turns_in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, d, role, text): each conversation's turns numbered from 1, null turns first, ties by role and text.

    Null role or text becomes empty; rows without a conversation are left out.
    """
    used = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    return running(used, ["conv_id"], ["turn", "role", "text"], ones("d"), {"d": 0}).drop("turn")


def rebuild(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """``turns`` with the first h of each conversation replaced by those of conversation c - c % every; h = crc32(c) % heads.

    All turns of that conversation if it has fewer, none if it is absent; a conversation may be left without turns.
    """
    base, head = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.filter("d = 1").select("conv_id", base.alias("_base"), head.alias("_h"))
    first = materialize(turns.filter((F.col("d") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "_base"), "heads")
    shared = ids.join(first, "_base").filter("d <= _h").select("conv_id", "d", "role", "text")
    lengths = materialize(first.groupBy(F.col("_base").alias("_b")).agg(F.max("d").alias("_n")), "lengths")
    own = turns.withColumns({"_base": base, "_h": head}).filter("d > _h").join(lengths, F.col("_base") == F.col("_b"), "left")
    given = F.least("_h", F.coalesce("_n", F.lit(0)))  # least passes over nulls
    return own.select("conv_id", (F.col("d") - F.col("_h") + given).alias("d"), "role", "text").unionByName(shared)


def _fingerprints(turns: DataFrame, seed: int, primes: tuple[int, int]) -> DataFrame:
    """``turns`` with fp{seed}, the fingerprint of the prefix up to the turn."""
    hashes = [F.pmod(F.xxhash64(F.lit(f"{seed}.{k}"), "role", "text"), F.lit(p)).alias(f"_x{k}") for k, p in enumerate(primes)]
    bases = [int(np.random.default_rng([seed, k]).integers(min(1 << 20, p - 1), p)) for k, p in enumerate(primes)]

    def terms(t: pa.Table) -> dict[str, np.ndarray]:
        """x * base ** d for both primes: their sum over a prefix is its fingerprint."""
        d, out = t.column("d").to_numpy(), {}
        for k, p in enumerate(primes):
            power, square, left = np.ones(len(d), np.int64), bases[k], d.copy()
            while left.any():
                power = np.where(left & 1, power * square % p, power)
                square, left = square * square % p, left >> 1
            out[f"_f{k}"] = t.column(f"_x{k}").to_numpy() * power % p
        return out

    added = running(turns.select("*", *hashes), ["conv_id"], ["d"], terms, {"_f0": primes[0], "_f1": primes[1]})
    return added.select(*turns.columns, (F.col("_f0") * F.lit(1 << 31) + F.col("_f1")).alias(f"fp{seed}"))


def members(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, d, rep, prep, words): the smallest id with the same first d turns, and with the same first d - 1.

    Compared turn by turn with that of the representative; d and rep together name a node of the trie.
    """
    seed, keys = 0, []
    while True:
        turns = materialize(_fingerprints(turns, seed, primes), "fingerprints")
        keys.append(f"fp{seed}")
        same = ["d", *keys]
        least = materialize(turns.groupBy(*same).agg(F.min(F.struct("conv_id", "role", "text")).alias("_r")), "representatives")
        least = least.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("_r.conv_id").alias("rep"), F.col("_r.role").alias("_role"), F.col("_r.text").alias("_text"))
        on = [F.col(c) == F.col(f"_{c}") for c in same]
        words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
        found = turns.join(least, on).select("conv_id", "d", "rep", ((F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))).alias("_same"), words)
        found = materialize(found, "members")
        before = found.select(F.col("conv_id").alias("_c"), (F.col("d") + 1).alias("_d"), F.col("rep").alias("prep"))
        found = materialize(found.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("d") == F.col("_d")), "left").drop("_c", "_d"), "members")
        # The prefixes before must be of one group as well; by induction from depth 1 equal groups are equal prefixes then.
        split = found.groupBy("rep", "d").agg(F.min("prep").alias("a"), F.max("prep").alias("b"), F.bool_and("_same").alias("s"))
        if split.filter("NOT s OR a <> b").isEmpty():
            return found.select("conv_id", "d", "rep", "prep", "words")
        seed += 1


def _summed_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (rep, d, prep, sums) with each of ``sums`` taken over the node's whole subtree."""
    state, reach = nodes.select("rep", "d", F.when(F.col("d") > 1, F.col("prep")).alias("_above"), *sums), 1
    while True:
        state = materialize(state, "subtrees")
        lower = state.filter("_above IS NOT NULL")
        if lower.isEmpty():
            return state.drop("_above")
        # Each node sends its sum to the ancestor ``reach`` above, and takes over that one's pointer.
        sent = lower.groupBy(F.col("_above").alias("_r"), (F.col("d") - reach).alias("_d")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        at = (F.col("rep") == F.col("_r")) & (F.col("d") == F.col("_d"))
        added = state.join(sent, at, "left").select("rep", "d", "_above", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
        jumps = state.select(F.col("rep").alias("_r"), F.col("d").alias("_d"), F.col("_above").alias("_next"))
        to = (F.col("_above") == F.col("_r")) & (F.col("d") - reach == F.col("_d"))
        state = materialize(added, "sums").join(jumps, to, "left").select("rep", "d", F.col("_next").alias("_above"), *sums)
        reach *= 2


def list_hashes(rows: DataFrame, key: list[str], id_col: str, ids: int = IDS) -> DataFrame:
    """(key, sha256): lower-case SHA-256 of each key's ids in ascending order, in decimal, joined by commas.

    Ids are cut, in order, into texts of at most ``ids`` ids; a key's texts stream through one hash, which holds one batch.
    """
    by = [*key, id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy() for c in by]
                new = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
                starts = np.union1d(np.r_[0, np.flatnonzero(new) + 1], np.arange(0, batch.num_rows, ids))
                texts = [",".join(map(str, x.tolist())) for x in np.split(columns[-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array(texts)], names=[*by, "texts"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for *own, text in zip(*(batch.column(c).to_pylist() for c in [*key, "texts"]), strict=True):
                if own != last:
                    if last is not None:
                        done.append([*last, state.hexdigest()])
                    last, state = own, hashlib.sha256()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=[*key, "sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*last, state.hexdigest()], types, strict=True)], names=[*key, "sha256"])

    types = [pa.int64()] * len(key) + [pa.string()]
    longs = ", ".join(f"`{c}` long" for c in key)
    texts = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, f"{longs}, `{id_col}` long, texts string")
    return texts.repartition(*key).sortWithinPartitions(*by).mapInArrow(digest, f"{longs}, sha256 string")


def trie(rows: DataFrame, every: int = 20, heads: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations (see ``rebuild``), the root, which has depth 0, included.

    conv_id (its smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (over its subtree, words of the node's last text times its members but one) and ends_sha256 (of
    the ids of the members that end there). Null turns come first, ties are ordered by role and text, repeated rows are
    turns of their own; null role or text is empty; rows without conv_id are left out; no rows give no nodes.
    """
    turns = materialize(turns_in_order(rows, conv_col, turn_col, role_col, text_col), "turns")
    ids = turns.filter("d = 1").select("conv_id")
    root, total = ids.agg(F.min("conv_id"), F.count("*")).first()
    found = members(rebuild(turns, every, heads), primes)
    nodes = found.groupBy("rep", "d").agg(F.count("*").alias("n_convs"), F.max("prep").alias("prep"), F.max("words").alias("_words"))
    nodes = materialize(nodes.withColumn("prep", F.coalesce("prep", F.lit(root).cast("long"))), "nodes")
    children = nodes.groupBy(F.col("prep").alias("_r"), (F.col("d") - 1).alias("_d")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("_words")).alias("saved_tokens")
    nodes = nodes.join(children, (F.col("rep") == F.col("_r")) & (F.col("d") == F.col("_d")), "left")
    nodes = materialize(nodes.select("rep", "d", "prep", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), saved), "nodes")
    n_leaves, saved_tokens, n_children = nodes.agg(F.sum("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)), F.count_if(F.col("d") == 1)).first()
    sums = _summed_up(nodes, ["n_leaves", "saved_tokens"])
    top = rows.sparkSession.createDataFrame([] if root is None else [(root, 0, None, total, n_children, n_leaves or 1, saved_tokens)], "rep long, d long, prep long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums, ["rep", "d"]).select(*top.columns).unionByName(top)
    last = found.groupBy("conv_id").agg(F.max("d").alias("d"), F.max_by("rep", "d").alias("rep"))
    empty = ids.join(found.filter("d = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("rep"))
    hashes = list_hashes(last.unionByName(empty), ["rep", "d"], "conv_id").withColumnsRenamed({"rep": "_r", "d": "_d"})
    nodes = nodes.join(hashes, (F.col("rep") == F.col("_r")) & (F.col("d") == F.col("_d")), "left")
    return nodes.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("prep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
