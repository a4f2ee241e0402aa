"""Pareto layers, shards and prefix tries against brute force: nulls, ties, repeated rows, hot groups, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lattice, layers, sharding, trie
from quillspark.operators import scans


def chain_levels(points, lower_bounds=None, most=99):
    """Longest chain of dominating points that ends in each, by sorting: dominators come first."""
    order = sorted(range(len(points)), key=lambda i: points[i])
    found = {}
    for i in order:
        above = [found[j] for j in found if all(a <= b for a, b in zip(points[j], points[i])) and points[j] != points[i]]
        found[i] = min(most + 1, max(1 if lower_bounds is None else lower_bounds[i], 1 + max(above, default=0)))
    return [found[i] for i in range(len(points))]


@pytest.mark.parametrize("seed", range(6))
def test_lattice_trees(seed):
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(0, 9, (400, 4)), axis=0)
    rng.shuffle(rows)
    given = rng.integers(1, 5, len(rows)) if seed % 2 else np.ones(len(rows), int)
    assert lattice.raise_levels(rows, given, 8).tolist() == chain_levels([tuple(r) for r in rows.tolist()], given, 8)
    tree, kept = lattice.skyline(rows)
    asked = rng.integers(0, 9, (200, 4))
    brute = [any((p <= a).all() and (p < a).any() for p in rows[kept]) for a in asked]
    assert tree.dominates(asked).tolist() == brute


def brute_layers(rows, most):
    """(type_layer, global_layer, n_equal) of (type, price, delay, discount, quantity) rows."""
    big = 1 << 62
    cost = [tuple(big if v is None else s * v for v, s in zip(r[1:], (1, 1, -1, -1))) for r in rows]
    out = [[0, 0, cost.count(c)] for c in cost]
    for k, of in enumerate([lambda i: rows[i][0], lambda i: "all"]):
        for g in {of(i) for i in range(len(rows))}:
            own = [i for i in range(len(rows)) if of(i) == g]
            distinct = sorted({cost[i] for i in own})
            level = dict(zip(distinct, chain_levels(distinct)))
            for i in own:
                out[i][k] = level[cost[i]] if level[cost[i]] <= most else 0
    return [tuple(o) for o in out]


@pytest.mark.parametrize("bucket, block", [(32_768, 8_192), (40, 16)])
def test_pareto_layers(spark, bucket, block):
    rng = np.random.default_rng(bucket)
    rows = [(rng.choice(["a", "a", "b", None]), *(None if rng.random() < 0.1 else int(v) for v in rng.integers(-5, 6, 4))) for _ in range(300)]
    rows += [rows[0]] * 40 + [("c", None, None, None, None)] * 3
    named = [(k, *r, "x", "y") for k, r in enumerate(rows)]
    table = spark.createDataFrame(named, "id long, kind string, price long, delay long, discount long, quantity long, level string, n_equal string")
    found = layers.pareto_layers(table, "kind", ["price", "delay"], ["discount", "quantity"], most=5, bucket=bucket, block=block)
    got = {r.id: (r.type_layer, r.global_layer, r.n_equal) for r in found.collect()}
    assert [got[k] for k in range(len(rows))] == brute_layers(rows, 5)
    assert layers.pareto_layers(table.limit(0), "kind", ["price", "delay"], ["discount", "quantity"]).count() == 0


def test_offers(spark):
    lines = spark.createDataFrame(
        [(1, 7, 9, 2, 10.0, 0.05, "2024-01-05"), (1, 7, 9, 2, 10.0, 0.05, "2024-01-05"), (2, 7, 9, None, 5.0, 0.1, "2024-01-01"), (3, 7, 9, 4, None, 0.02, None),
         (1, 8, 9, 1, 3.0, None, "2023-12-30"), (1, 8, 9, 1, None, None, "2023-12-31"), (None, 8, 9, 1, 1.0, 0.0, "2024-01-05"), (1, None, 9, 1, 1.0, 0.0, None), (1, 7, None, 1, 1.0, 0.0, None), (1, 6, 9, None, float("nan"), None, None), (1, 5, 9, 1, 9.0, 0.0, None)],
        "sale_id long, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at string",
    ).withColumn("shipped_at", F.to_timestamp("shipped_at")).withColumn("kind", F.lit("other"))
    sales = spark.createDataFrame([(1, "2024-01-01 23:00:00"), (2, "2024-01-03 00:00:00"), (3, None)], "sale_id long, sold_at string").withColumn("sold_at", F.to_timestamp("sold_at"))
    items = spark.createDataFrame([(7, 2.0, "t"), (8, 0.0, None), (6, 1.0, "t")], "item_id long, price double, kind string")
    got = {r.item_id: tuple(r)[2:] for r in layers.offers(lines, sales, items).collect()}
    # 7: 2 * 1000 * 95 / (200 * 4); mean discount (5 + 5 + 10 + 2) / 4; days 4, 4, -2.
    assert got[7] == ("t", 237, 5, 2, 4)
    assert got[8] == (None, None, 0, -2, 1)  # a price below a cent; days -2 and -1
    assert got[6] == ("t", None, None, None, None) and got[5] == (None, None, 0, None, 1)


def test_running_sums_cross_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(o), int(v)) for k, o, v in zip(rng.choice([1, 1, 1, 2, 5], 500), range(500), rng.integers(0, 7, 500))]
    table = spark.createDataFrame(rows, "k long, o long, v long")
    found = scans.running(table, ["k"], ["o"], lambda t: {"s": t.column("v").to_numpy(), "m": t.column("v").to_numpy()}, {"s": 0, "m": 7})
    total, want = defaultdict(int), {}
    for k, o, v in sorted(rows):
        total[k] += v
        want[o] = (total[k], total[k] % 7)
    assert {r.o: (r.s, r.m) for r in found.collect()} == want


def shards_of(rows, n):
    """Brute force: groups in order, the least capacity by trying sums, cuts nearest to equal shares."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    size = {t: sum(len(t.encode()) + 8 for _ in ids) for t, ids in groups.items()}
    own, left = [], sum(size.values())
    for t in sorted(groups, key=lambda t: (-size[t], min(groups[t]))):
        if len(own) < n and size[t] * (n - len(own)) >= left:
            own.append(t)
            left -= size[t]
        else:
            break
    rest = sorted((t for t in groups if t not in own), key=lambda t: min(groups[t]))
    places, s = [0, *itertools.accumulate(size[t] for t in rest)], n - len(own)

    def fits(c):
        at = 0
        for _ in range(s):
            at = max(p for p in places if p <= at + c)
        return at == places[-1]

    least = next((c for c in sorted({b - a for a in places for b in places if b > a}) if c >= max((size[t] for t in rest), default=0) and fits(c)), 0)
    return own, rest, places, least, size


@pytest.mark.parametrize("seed, places", [(0, 65_536), (1, 4), (2, 30)])
def test_shards(spark, seed, places):
    rng = np.random.default_rng(seed)
    texts = ["é" * int(n) for n in rng.integers(0, 60, 40)] + [f"{k}" * int(n) for k, n in enumerate(rng.integers(1, 90, 60))]
    rows = [(k * 3, texts[int(j)]) for k, j in enumerate(rng.integers(0, len(texts), 300))] + [(5000 + k, "hot " * 20) for k in range(150)] + [(1, None), (2, ""), (10_007, "z" * 700)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, shard string, size string")
    found = sharding.shard(table, 8, places=places).collect()
    own, rest, ends, least, size = shards_of(rows, 8)
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    text = dict(rows)
    assert all((r["size"], r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 8, zlib.crc32((text[r.doc_id] or "").encode())) for r in found)
    of = {}
    for r in found:
        assert of.setdefault(text[r.doc_id] or "", r.shard) == r.shard
    assert [of[t] for t in own] == list(range(len(own)))
    assert [of[t] for t in rest] == sorted(of[t] for t in rest)
    held = [sum(size[t] for t in rest if of[t] == k) for k in range(len(own), 8)]
    assert max(held) == least
    for k in {r.shard for r in found}:
        slots = [(r.group_id, r.doc_id) for r in sorted((x for x in found if x.shard == k), key=lambda x: x.slot)]
        assert slots == sorted(slots) and sorted(x.slot for x in found if x.shard == k) == list(range(len(slots)))


def test_shards_of_odd_tables(spark):
    table = spark.createDataFrame([(None, "a"), (None, None), (4, "a"), (4, "a"), (-(2**40), "b" * 100_000)], "doc_id long, text string")
    found = sharding.shard(table, 3).collect()
    assert len(found) == 5 and {r.shard for r in found} <= {0, 1, 2} and sorted(r.slot for r in found if r.group_id is None) != []
    assert sharding.shard(table.limit(0), 3).count() == 0
    assert sharding.shard(table.filter("doc_id IS NULL AND text IS NULL"), 3).first()[1:3] == (8, 0)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20
        convs[c] = own.get(base, [])[:h] + t[h:]
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    words = {p: 0 if not p else len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in nodes}
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids(p), sum(not kids(q) for q in below), sum((len(nodes[q]) - 1) * words[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("primes", [trie.PRIMES, (5, 3)])
def test_trie(spark, primes):
    rng = np.random.default_rng(7)
    said = ["hello there", "how are you", "", "fine\tthanks \n you", None]
    rows = [(int(c), None if t == 0 and c % 3 == 0 else t, rng.choice(["user", "bot", None]), said[int(rng.integers(5))] if t else "start") for c in rng.choice(90, 45, replace=False) for t in range(int(rng.integers(1, 5)))]
    rows += [(200 + k, t, "user", f"same {t}") for k in range(30) for t in range(3)]  # one hot sequence
    rows += [(400, 1, "u", "b"), (400, 1, "u", "a"), (400, 1, "u", "a"), (None, 1, "u", "a")] + [(500, t, "u", f"long {t % 7}") for t in range(70)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, d string, rep string")
    got = sorted((tuple(r) for r in trie.trie(table, primes=primes).collect()), key=str)
    assert got == brute_trie(rows)


def test_empty_trie(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(table).count() == 0
    alone = spark.createDataFrame([(3, 1, "u", "x")], table.schema)  # its first turns are those of an absent conversation
    assert [tuple(r)[:7] for r in trie.trie(alone).collect()] == [x[:7] for x in brute_trie([(3, 1, "u", "x")])]
