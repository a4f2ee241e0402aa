"""MinHash near-duplicates with sequential Bayesian verification, and their connected components.

1. Sketch: each text's distinct word shingles as sorted 64-bit hashes, their count, a 128-bit key of the whole set and
   one hash per band of the MinHash signature.  Equal sets form a class, which its smallest id represents.
2. Bands: representatives that share a band are candidates.  In each bucket the member that meets most others (over all
   its buckets) is the hub; hub and member are compared, so a bucket costs as many pairs as it has members.
3. Verification: signatures are compared batch by batch, and a pair is dropped once the posterior probability that its
   similarity reaches the threshold (uniform prior, Beta posterior) falls below ``miss``; survivors are verified on the
   full sets.
4. Rest: buckets whose members still lie in several components have their other pairs compared too, in place within
   blocks of bounded size, by signature and then by 32-bit hashes of the sets; what leaves a block are links between
   components, few as a spanning forest, and they are verified on the full sets.
5. Components of the verified links, by alternating large-star and small-star until each is a star.

Only (id, band) rows, signatures of candidates and the sets of candidates are moved; no group is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.storage import materialize

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
#: Words whose hash a worker keeps; then it starts anew.
CACHE_WORDS = 300_000
#: Members of a block in step 4: a task holds two blocks of signatures at once.
BLOCK = 512


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, cache: _WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased, split at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(tokens) < width:
        acc = np.array([len(tokens)], dtype=np.uint64) * _M2
        for x in h:
            acc = (acc ^ (acc >> _S29)) * _M1 + x
        return acc
    n = len(tokens) - width + 1
    acc = h[:n] * _M2
    for j in range(1, width):
        acc = (acc ^ (acc >> _S29)) * _M1 + h[j : j + n]
    acc ^= acc >> _S32
    return np.unique(acc)


def plan_bands(threshold: float, miss: float, permutations: int = 128) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with a probability of at most ``miss``."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    raise ValueError("no banding reaches this miss probability")


def least_matches(threshold: float, miss: float, total: int, batch: int) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes, fewer than m matches leave a posterior below ``miss`` for similarity >= threshold.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at the threshold
    is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


class Signer:
    """MinHash signatures: 32-bit minima of multiply-shift hashes, and a hash per band."""

    def __init__(self, rows: int, bands: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
        self.salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _M2

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, len(hashes), 2048):
            grid = np.multiply.outer(hashes[lo : lo + 2048], self.a)
            grid += self.b
            np.minimum(least, grid.min(axis=0), out=least)
        return (least >> _S32).astype(np.uint32)

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        grid = signature.astype(np.uint64).reshape(self.bands, self.rows)
        acc = self.salt.copy()
        for j in range(self.rows):
            acc = (acc ^ (acc >> _S29)) * _M1 + grid[:, j]
        return (acc ^ (acc >> _S32)).view(np.int64)


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketch(signer_args: tuple, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, cache = Signer(*signer_args), _WordHashes()
        for batch in batches:
            count, key, bands = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, cache, width)
                count.append(len(hashes))
                key.append(_set_key(hashes) if len(hashes) else None)
                bands.append(signer.band_hashes(signer.signature(hashes)) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "th", "n", "key", "bands"],
            )

    return run


def _details(signer_args: tuple, width: int):
    """Signature and set of each candidate; rows of the same id with another text are left out by their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, cache = Signer(*signer_args), _WordHashes()
        for batch in batches:
            ids, count, sig, small, full = [], [], [], [], []
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = shingle_hashes(text, cache, width)
                if len(hashes) and _set_key(hashes) == key:
                    ids.append(i)
                    count.append(len(hashes))
                    sig.append(signer.signature(hashes).tobytes())
                    small.append(np.unique((hashes >> _S32).astype(np.uint32)).tobytes())
                    full.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(count, pa.int64()), *(pa.array(x, pa.binary()) for x in (sig, small, full))], ["id", "n", "sig", "small", "shingles"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


def _alive(sa: np.ndarray, sb: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs that no batch prunes."""
    left, matched, done = np.arange(len(sa)), np.zeros(len(sa), dtype=np.int32), 0
    for n, least in table:
        matched = matched + (sa[left, done:n] == sb[left, done:n]).sum(axis=1, dtype=np.int32)
        keep = matched >= least
        left, matched, done = left[keep], matched[keep], n
    return left


def _prune(table: list[tuple[int, int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _alive(_matrix(batch.column(2), width), _matrix(batch.column(3), width), table) if batch.num_rows else []
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def _verify(num: int, den: int):
    """Links: pairs with den * |intersection| >= num * |union|, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def _block_links(table: list[tuple[int, int]], rows_per_band: int, width: int, num: int, den: int):
    """Of each block (rows in order of bucket and block): candidate links between different labels.

    A pair is looked at in the bucket of the first band it shares only.  Signatures prune it; what is left is compared on
    the sets' 32-bit hashes, which are off by collisions.  What both sets may have lost to them is known, so no pair is
    dropped that the full sets could link.  Links are given out to be verified; one that joins labels for the rest of the
    block must be clear of the threshold by more than false matches can make up, whose number grows with both sizes.
    """

    def compare(bucket_band: int, rows: list[tuple]) -> tuple[list, list]:
        ids = np.array([r[0] for r in rows])
        labels = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
        sizes = np.array([r[2] for r in rows], dtype=np.int64)
        sigs = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32).reshape(-1, width)
        sets = [np.frombuffer(r[4], dtype=np.uint32) for r in rows]
        lost = sizes - np.array([len(s) for s in sets], dtype=np.int64)
        side = np.array([r[5] for r in rows])
        out_a, out_b = [], []
        for i in range(len(ids)):
            other = np.arange(i + 1, len(ids))
            other = other[(labels[other] != labels[i]) & ((side[other] != side[i]) | (side[i] < 0))]
            other = other[den * np.minimum(sizes[other], sizes[i]) >= num * np.maximum(sizes[other], sizes[i])]
            if len(other):
                other = other[_alive(np.broadcast_to(sigs[i], (len(other), width)), sigs[other], table)]
            if len(other):
                same = (sigs[other] == sigs[i]).reshape(len(other), -1, rows_per_band).all(axis=2)
                other = other[same.argmax(axis=1) == bucket_band]
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            at = np.searchsorted(sets[i], flat)
            at[at == len(sets[i])] = 0
            starts = np.cumsum([0] + [len(sets[j]) for j in other[:-1]])
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
            total = sizes[other] + sizes[i]
            most = both + np.minimum(lost[other], lost[i])
            false = sizes[other] * float(sizes[i]) / 2.0**32
            least = both - np.ceil(2 + false + 10 * np.sqrt(false)).astype(np.int64)
            for j, high, low, n in zip(other.tolist(), most.tolist(), least.tolist(), total.tolist(), strict=True):
                if labels[j] == labels[i] or den * high < num * (n - high):
                    continue
                out_a.append(int(min(ids[i], ids[j])))
                out_b.append(int(max(ids[i], ids[j])))
                if den * low >= num * (n - low):
                    labels[labels == labels[j]] = labels[i]
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            a, b = [], []
            for place, band, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, band, lo, hi) != block:
                    if len(rows) > 1:
                        x, y = compare(block[0], rows)
                        a += x
                        b += y
                    block, rows = (place, band, lo, hi), []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(rows) > 1:
            x, y = compare(block[0], rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b): the smallest id that links reach. Links lead both ways.

    Alternating large-star and small-star (Kiveris and others 2014): the greater neighbours of a node, then its lesser
    ones and itself, are linked with its least neighbour instead.  Both keep what is connected; nothing changes once
    every tree is a star around its smallest id, which takes at most O(log^2 n) rounds, whatever the links' shape.
    """
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    edges = materialize(edges.distinct(), "edges")

    def tops() -> DataFrame:
        # Written, so that a join with a hot node has exchanges of its own, which adaptive execution may split.
        return materialize(edges.groupBy("hi").agg(F.min("lo").alias("top"), F.max("lo").alias("last")), "tops")

    while True:
        top = tops()
        inner = top.select(F.col("hi").alias("lo"), F.col("top").alias("above"))
        if top.filter("top <> last").isEmpty() and edges.join(inner, "lo", "left_semi").isEmpty():
            break
        large = edges.join(inner, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"))
        edges = materialize(large.distinct(), "edges")
        small = edges.join(tops().select("hi", "top"), "hi")
        small = small.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("top").alias("lo")).filter("hi <> lo")
        edges = materialize(small.distinct(), "edges")
    stars = top.select(F.col("hi").alias("id"), F.col("top").alias("label"))
    return materialize(ids.join(stars, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")


def near_duplicates(
    docs: DataFrame,
    similarity: tuple[int, int] = (80, 100),
    width: int = 5,
    miss: float = 1e-6,
    permutations: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Near-duplicate components of ``docs`` by Jaccard similarity of word shingles, at least ``similarity`` = (num, den).

    Returns a row per input row: ``id_col`` (an integer), ``text_hash``, ``n_shingles``, ``component_id`` (smallest id
    reachable through links) and ``kept`` (the row's id is its component's).  Defined cases: a null text, or one without
    words, has an empty set and is linked with nothing; a text of fewer than ``width`` words is one shingle; a row whose
    id is null is its own, with a null component, and kept; rows that share an id are judged each by its own text;
    equal rows get equal answers; empty tables give no rows; other columns are not read.
    """
    num, den = similarity
    threshold = num / den
    rows, bands = plan_bands(threshold, miss, permutations)
    signer, size = (rows, bands), rows * bands
    table = least_matches(threshold, miss, size, max(1, size // 8))
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    sketch = materialize(source.mapInArrow(_sketch(signer, width), "id long, th long, n long, key binary, bands array<long>"), "sketch")

    known = sketch.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    member = known.select("id", "key", F.xxhash64("key").alias("kh"), F.posexplode("bands").alias("place", "band"))
    shared = member.groupBy("band").agg(F.min("kh").alias("lo"), F.max("kh").alias("hi")).filter("lo <> hi").select("band")
    bucket = materialize(member.join(shared, "band").groupBy("place", "band", "key").agg(F.min("id").alias("id")), "buckets")

    sizes = bucket.groupBy("band").agg(F.count("*").alias("size"))
    scores = bucket.join(sizes, "band").groupBy("id").agg(F.sum("size").alias("score"))
    hubs = bucket.join(scores, "id").groupBy("band").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("top"))
    hubs = hubs.select("band", (-F.col("top.neg")).alias("hub"))
    pairs = bucket.join(hubs, "band").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = materialize(pairs.distinct(), "pairs")

    nodes = bucket.select("id", "key").distinct()
    texts = source.select("id", "t").join(nodes, "id").select("id", "key", "t")
    detail = materialize(texts.mapInArrow(_details(signer, width), "id long, n long, sig binary, small binary, shingles binary"), "details")

    def side(name: str, *columns: str) -> DataFrame:
        return detail.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def verified(candidates: DataFrame) -> DataFrame:
        full = candidates.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
        return full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verify(num, den), "a long, b long")

    both = pairs.join(side("a", "sig", "n"), "a").join(side("b", "sig", "n"), "b")
    both = both.filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    survivors = both.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(table, size), "a long, b long")
    links = materialize(verified(survivors), "links")
    labels = components(links)

    placed = bucket.join(labels, "id", "left").select("place", "band", "id", F.coalesce("label", "id").alias("label"))
    split = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rest = placed.join(split.select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "band")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("place", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "label", F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1).alias("side"))
    rest = rest.join(detail.select("id", "n", "sig", "small"), "id").select("place", "band", "lo", "hi", "id", "label", "n", "sig", "small", "side")
    rest = rest.repartition("place", "band", "lo", "hi").sortWithinPartitions("place", "band", "lo", "hi")
    near = rest.mapInArrow(_block_links(table, rows, size, num, den), "a long, b long").distinct()
    more = materialize(verified(near), "more")
    if not more.isEmpty():
        labels = components(links.union(more))

    classes = known.groupBy("key").agg(F.min("id").alias("rep"))
    classes = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("label", "rep").alias("component"))
    # Written first: the join then has exchanges of its own, which adaptive execution may split where a class is hot.
    out = sketch.join(materialize(classes, "classes"), "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(~F.col("kept"))
    gone = gone.select(F.col(id_col).alias("_q_id"), F.col("text_hash").alias("_q_hash")).distinct()
    same = (docs[id_col].cast("long") == gone["_q_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_q_hash"])
    return docs.join(gone, same, "left_anti")
