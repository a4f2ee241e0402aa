"""Work retrieval by weighted n-grams, exact lines, priors, and literal search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import grams as G
from quillspark.functions import similarity as M
from quillspark.operators.scans import ones, running
from quillspark.plans.storage import materialize

#: Rows of a gram table up to which it is broadcast (about 50 MB); beyond, the join shuffles by gram.
BROADCAST_ROWS = 1_000_000
#: Lines that are compared with every query at once.
LINES_BLOCK = 1_000
#: UTF-8 bytes of lines up to which their index is sent to every task (it takes some 30 times as much there).
INDEX_BYTES = 8 << 20
#: Rows of an index of works up to which it is sent to every task (some 30 MB there).
HELD_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table that a count has shown to be small; else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_lines(lines: DataFrame, *columns: str) -> list | None:
    """All lines in order of ``columns``, the text being the last, if a sum has shown them to be small; else None."""
    size = lines.agg(F.sum(F.octet_length(columns[-1]) + 16)).first()[0] or 0
    return lines.orderBy(*columns).collect() if size <= INDEX_BYTES else None


def grams_of(text: str, n: int) -> set[str]:
    """Distinct character n-grams; a shorter text is its own, an empty one has none."""
    return {text[i : i + n] for i in range(len(text) - n + 1)} or ({text} if text else set())


class GramLines:
    """Lines by the n-grams that they hold: how many a text shares with each is one count over the lists of its grams."""

    def __init__(self, texts: list[str], n: int):
        sets = [grams_of(t, n) for t in texts]
        self.n, self.sizes = n, np.array([len(g) for g in sets], np.int64)
        self.ids: dict[str, int] = {}
        pairs = np.array([(self.ids.setdefault(g, len(self.ids)), k) for k, own in enumerate(sets) for g in own], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.lines = pairs[order, 1].astype(np.int32)
        self.starts = np.searchsorted(pairs[order, 0], np.arange(len(self.ids) + 1))

    def shared(self, text: str) -> tuple[np.ndarray, int]:
        """The number of grams shared with each line, and that of the text."""
        grams = grams_of(text, self.n)
        ids = np.array([k for g in grams if (k := self.ids.get(g)) is not None], np.int64)
        many = self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.lines[at], minlength=len(self.sizes)), len(grams)


class GramCodes:
    """Character n-grams as numbers: a gram's characters, numbered from 1, are the digits of its code.

    ``ids`` finds the known grams of many texts at once; grams with a character that no known one has are unknown.
    """

    def __init__(self, grams: list[str], n: int):
        self.n = n
        points = np.unique(_points(grams))
        self.base = len(points) + 1
        if self.base**n >= 1 << 62:
            raise OverflowError("too many different characters")
        self.digits = np.zeros(int(points[-1]) + 2 if len(points) else 1, np.int64)
        self.digits[points] = np.arange(1, self.base)
        codes = np.array([self._code(g) for g in grams], np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def _digits(self, points: np.ndarray) -> np.ndarray:
        return self.digits[np.minimum(points, len(self.digits) - 1)]  # the last one is no character's

    def _code(self, gram: str) -> int:
        code = 0
        for d in self._digits(_points([gram])).tolist():
            if not d:
                return -1
            code = code * self.base + d
        return code

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of every known n-gram of the texts, with repeats; a shorter text is its own."""
        sizes = np.array([len(t) for t in texts], np.int64)
        digits = self._digits(_points(texts))
        rows = np.repeat(np.arange(len(texts)), sizes)
        codes, known = digits.copy(), digits > 0
        for k in range(1, self.n):
            codes[:-k] = codes[:-k] * self.base + digits[k:]
            known[:-k] &= digits[k:] > 0
        ends = np.cumsum(sizes)
        known &= np.arange(len(digits)) + self.n <= np.repeat(ends, sizes)
        short = np.flatnonzero((sizes > 0) & (sizes < self.n))
        rows = np.concatenate([rows[known], short])
        codes = np.concatenate([codes[known], np.array([self._code(texts[k]) for k in short.tolist()], np.int64)])
        at = np.searchsorted(self.codes, codes)
        hit = at < len(self.codes)
        hit[hit] = self.codes[at[hit]] == codes[hit]
        return rows[hit], self.order[at[hit]]


def _points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _lots(sizes: list[int], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that hold about ``most`` in all, and ``rows`` at the utmost."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and (total + size > most or k - start >= rows):
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class WorkBags:
    """Works as bags of numbered things: what texts score with each of them, for many texts at once.

    ``things``, ``works`` and ``counts`` are an index's columns; ``terms`` gives what a thing that is said ``q`` times adds to
    a work: its rows are of one weight, ``weight`` names a thing's, and its columns are min(q, count). Without terms it adds
    ``q`` times the count.
    """

    def __init__(self, things: np.ndarray, works: np.ndarray, counts: np.ndarray, n_works: int, weight: np.ndarray, terms: np.ndarray | None = None):
        order = np.argsort(things, kind="stable")
        self.works, self.counts, self.n_works = works[order], counts[order], n_works
        self.starts = np.searchsorted(things[order], np.arange(len(weight) + 1))
        self.weight, self.terms = weight, terms

    def scores(self, rows: np.ndarray, things: np.ndarray, n_rows: int) -> np.ndarray:
        """A row of scores with all works for each of the ``n_rows`` texts, from the things that they say."""
        many = len(self.weight)
        keys, said = np.unique(rows * many + things, return_counts=True)
        rows, things = keys // many, keys % many
        out = np.zeros(n_rows * self.n_works)
        size = self.starts[things + 1] - self.starts[things]
        for a, b in _lots(size.tolist(), 1 << 20, len(size)):
            n = size[a:b]
            at = np.repeat(self.starts[things[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q = np.repeat(said[a:b], n)
            term = q * self.counts[at] if self.terms is None else self.terms[np.repeat(self.weight[things[a:b]], n), np.minimum(q, self.counts[at])]
            out += np.bincount(np.repeat(rows[a:b], n) * self.n_works + self.works[at], term, minlength=len(out))
        return out.reshape(n_rows, self.n_works)


def _per_text(queries: DataFrame, index, answer: Callable[[object, str], list[tuple]], schema: str) -> DataFrame:
    """(query_id, ...) for each row of ``queries`` (id, text): what ``answer`` gives for the index and the text."""
    held = queries.sparkSession.sparkContext.broadcast(index)
    schema = f"query_id {queries.schema[0].dataType.simpleString()}, {schema}"
    arrow = queries.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x, *row) for x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in answer(held.value, text or "")]
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return queries.mapInArrow(run, schema)


def gram_index(lines: DataFrame, work: str, text: Column, n: int = 4) -> DataFrame:
    """(work_id, gram, tf): the gram multiset of each work, over all its lines."""
    rows = lines.select(F.col(work).alias("work_id"), F.explode(G.char_grams(text, n)).alias("gram"))
    return rows.groupBy("work_id", "gram").agg(F.count("*").alias("tf"))


def gram_df(index: DataFrame) -> DataFrame:
    """(gram, df): in how many works a gram occurs."""
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def work_scores(queries: DataFrame, query: str, text: Column, index: DataFrame, n: int = 4) -> DataFrame:
    """(query_id, work_id, score): sum of min(query tf, work tf) ln(1 + works / df).

    Grams that no work has add nothing, so they are dropped by a semi-join before the query side is shuffled.  The terms
    are summed as decimals: the score does not depend on their order.
    """
    index = index.cache()
    total = index.select("work_id").distinct().count()
    weights = gram_df(index).select("gram", F.ln(1 + F.lit(float(total)) / F.col("df")).alias("idf"))
    rows = queries.select(F.col(query).alias("query_id"), F.explode(G.char_grams(text, n)).alias("gram"))
    known = rows.join(broadcast_if_small(weights), "gram").groupBy("query_id", "gram").agg(F.count("*").alias("q"), F.first("idf").alias("idf"))
    pairs = known.join(broadcast_if_small(index), "gram")
    term = (F.least("q", "tf") * F.col("idf")).cast("decimal(18,6)")
    return pairs.groupBy("query_id", "work_id").agg(F.sum(term).cast("double").alias("score"))


def held_works(index: DataFrame, n: int) -> tuple[list, GramCodes, WorkBags] | None:
    """The works in order, their grams and bags, if a count has shown the index (work_id, gram, tf) to be small; else None.

    Scores are in millionths, as decimals round them.
    """
    if index.limit(HELD_ROWS + 1).count() > HELD_ROWS:
        return None
    held = index.toArrow()
    ids = pc.unique(held["work_id"]).sort()
    grams = pc.unique(held["gram"])
    try:
        codes = GramCodes(grams.to_pylist(), n)
    except OverflowError:
        return None
    things, works = (pc.index_in(held[c], value_set=v).to_numpy().astype(np.int64) for c, v in (("gram", grams), ("work_id", ids)))
    counts, df = held["tf"].to_numpy(), np.bincount(things, minlength=len(grams))
    kinds, weight = np.unique(df, return_inverse=True)
    most = np.zeros(len(kinds), np.int64)
    np.maximum.at(most, weight[things], counts)
    if len(kinds) * (int(most.max(initial=0)) + 1) > HELD_ROWS:
        return None
    idf = index.sparkSession.createDataFrame([(int(d),) for d in kinds], "df long").select("df", F.ln(1 + F.lit(float(len(ids))) / F.col("df")).alias("idf")).collect()
    idf = {r["df"]: r["idf"] for r in idf}
    terms = np.zeros((len(kinds), int(most.max(initial=0)) + 1))
    for i, (d, top) in enumerate(zip(kinds.tolist(), most.tolist(), strict=True)):
        for q in range(1, top + 1):
            terms[i, q] = int(Decimal(repr(q * idf[d])).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return ids.to_pylist(), codes, WorkBags(things, works, counts, len(ids), weight, terms)


def top_works(queries: DataFrame, query: str, text: Column, index: DataFrame, n: int = 4, distinct: bool = False) -> DataFrame:
    """(query_id, work_id, score, margin): :func:`top_with_margin` of :func:`work_scores`.

    Where the works are few enough to be held, texts are scored where they lie and nothing but ids is shuffled; texts that
    share an id are one text to the scores, so those (and all, where the works are many) go through the join.  Where ids are
    known to be ``distinct``, none are looked for.
    """
    index = materialize(index, "index")
    if (held := held_works(index, n)) is None:
        return top_with_margin(work_scores(queries, query, text, index, n))
    many, several = queries, 0
    if not distinct:
        shared = materialize(queries.groupBy(F.col(query).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").select("__id"), "shared")
        several = shared.count()
    if several:
        same = F.col(query).eqNullSafe(F.col("__id"))
        some = broadcast_if_small(shared)
        many = queries.join(some, same, "left_anti")
    rows = many.select(F.col(query).alias("query_id"), text.alias("t"))
    sent = queries.sparkSession.sparkContext.broadcast(held)
    schema = f"query_id {rows.schema[0].dataType.simpleString()}, work_id {index.schema['work_id'].dataType.simpleString()}, score double, margin double"
    work_type = queries.sparkSession.createDataFrame([], schema).toArrow().schema.field("work_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, bags = sent.value
        names = pa.array(ids, work_type)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _lots([len(t) for t in texts], 1 << 17, max(1, (1 << 20) // max(1, len(ids)))):
                found = bags.scores(*codes.ids(texts[a:b]), b - a)
                if not found.size:
                    continue
                best = found.argmax(axis=1)  # works are in order: the least of equal ones
                at = np.arange(b - a)
                score = found[at, best] / 1e6
                found[at, best] = 0
                second = found.max(axis=1) / 1e6
                own = np.flatnonzero(score > 0)
                score, second = score[own], second[own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(own), names.take(best[own]), pa.array(score), pa.array((score - second) / score)], ["query_id", "work_id", "score", "margin"])

    found = rows.mapInArrow(run, schema)
    return found.unionByName(top_with_margin(work_scores(queries.join(some, same, "left_semi"), query, text, index, n))) if several else found


def top_with_margin(scores: DataFrame) -> DataFrame:
    """(query_id, work_id, score, margin): the best work (ties by id) and how far, relatively, the second is behind."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "work_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    top = ranked.filter("rank = 1")
    margin = F.when(F.col("score") > 0, (F.col("score") - F.col("second")) / F.col("score")).otherwise(F.lit(0.0))
    return top.select("query_id", "work_id", "score", margin.alias("margin"))


def with_context(clips: DataFrame, session: str, order: str, text: str, width: int) -> DataFrame:
    """``context``: the clip's text with those of ``width`` neighbours on either side, within its session."""
    near = Window.partitionBy(session).orderBy(order)
    parts = [F.lag(text, k).over(near) for k in range(width, 0, -1)] + [F.col(text)] + [F.lead(text, k).over(near) for k in range(1, width + 1)]
    return clips.withColumn("context", F.concat_ws(" ", *parts))


def retrieve_widening(clips: DataFrame, clip: str, session: str, order: str, text: str, skeleton, index: DataFrame, floor: float = 0.05) -> DataFrame:
    """The best work per clip from +-1 context, or from +-2 where the first margin is below ``floor``; ``width`` tells."""
    narrow = with_context(clips, session, order, text, 1)
    # Written: the rows below the floor are looked for in it, and it is part of the result.
    first = materialize(top_works(narrow, clip, skeleton(F.col("context")), index), "first").withColumn("width", F.lit(1))
    unsure = first.filter(F.col("margin") < floor).select(F.col("query_id").alias(clip))
    wide = with_context(clips, session, order, text, 2).join(unsure, clip, "left_semi")
    second = top_works(wide, clip, skeleton(F.col("context")), index).withColumn("width", F.lit(2))
    return first.filter(F.col("margin") >= floor).unionByName(second)


def exact_index(lines: DataFrame, text: Column, work: str, line: str, order: list[str]) -> DataFrame:
    """(text, work_id, line_id): the first line in order of each text."""
    key = F.struct(*order, work, line)
    return lines.select(text.alias("text"), key.alias("k")).filter("text <> ''").groupBy("text").agg(F.min("k").alias("k")).select("text", F.col(f"k.{work}").alias("work_id"), F.col(f"k.{line}").alias("line_id"))


def session_priors(hits: DataFrame, following: DataFrame | None = None, weight: float = 0.8, same: float = 0.8, next_: float = 0.5) -> DataFrame:
    """(session, work_id, prior) from counted hits (session, work_id, n): 1 + weight * share, more for the session's
    most frequent work (ties by id) and for the one that follows it, when ``following`` (work_id, next_work) is given."""
    total = Window.partitionBy("session")
    out = hits.withColumn("prior", 1 + weight * F.col("n") / F.sum("n").over(total))
    if following is None:
        return out.select("session", "work_id", "prior")
    best = hits.groupBy("session").agg(F.max(F.struct("n", (-F.col("work_id")).alias("neg"))).alias("m")).select("session", (-F.col("m.neg")).alias("previous"))
    ahead = best.join(following, best["previous"] == following["work_id"]).select("session", F.col("next_work").alias("work_id"), F.lit(next_).alias("extra"))
    again = best.select("session", F.col("previous").alias("work_id"), F.lit(same).alias("extra"))
    extra = ahead.unionByName(again).groupBy("session", "work_id").agg(F.sum("extra").alias("extra"))
    out = out.join(extra, ["session", "work_id"], "full")
    return out.select("session", "work_id", (F.coalesce("prior", F.lit(1.0)) + F.coalesce("extra", F.lit(0.0))).alias("prior"))


def next_work(lines: DataFrame, work: str, order: str) -> DataFrame:
    """(work_id, next_work): works in order of their last line; the last one has none.

    Works are numbered in ranges of that order, and each is joined with the next number: no task sees them all.
    """
    last = lines.groupBy(F.col(work).alias("work_id")).agg(F.max(order).alias("last"))
    numbered = materialize(running(last, [], ["last", "work_id"], ones("n"), {"n": 0}).select("work_id", "n"), "numbered")
    following = numbered.select(F.col("work_id").alias("next_work"), (F.col("n") - 1).alias("n"))
    return numbered.join(following, "n", "left").select("work_id", "next_work")


def literal_search(queries: DataFrame, query: str, text: Column, lines: DataFrame, work: str, line: str, line_text: Column, top: int = 5, least: float = 0.0) -> DataFrame:
    """(query_id, work_id, line_id, score, rank): lines by overlap coefficient of 4-gram sets, the best line of each work.

    Shared grams are counted against an index of the lines where those are small; else by an equi-join of grams, in which
    the grams of many lines and queries make many rows.
    """
    known = lines.select(F.col(work).alias("work_id"), F.col(line).alias("line_id"), F.regexp_replace(line_text, r"\s+", "").alias("t")).filter("t <> ''")
    if (held := held_lines(known, "work_id", "line_id", "t")) is not None:
        names = [(r["work_id"], r["line_id"]) for r in held]
        works = np.cumsum([0, *(a[0] != b[0] for a, b in zip(names, names[1:]))]) if held else np.zeros(0, np.int64)
        kinds = [known.schema[c].dataType.simpleString() for c in ("work_id", "line_id")]
        rows = queries.select(F.col(query).alias("query_id"), F.regexp_replace(text, r"\s+", "").alias("t"))

        def answer(index, t: str) -> list[tuple]:
            lines, works, names = index
            shared, size = lines.shared(t)
            own = np.flatnonzero(shared)
            if not len(own):
                return []
            score = shared[own] / np.minimum(size, lines.sizes[own])
            starts = np.flatnonzero(np.diff(works[own], prepend=-1))
            best = np.maximum.reduceat(score, starts)
            out = []
            for k in np.argsort(-best, kind="stable")[:top]:  # works are in order: equal scores stay so
                if best[k] >= least:
                    end = starts[k + 1] if k + 1 < len(starts) else len(own)
                    first = own[starts[k] + int(np.argmax(score[starts[k] : end]))]
                    out.append((*names[first], float(best[k]), len(out) + 1))
            return out

        return _per_text(rows, (GramLines([r["t"] for r in held], 4), works, names), answer, f"work_id {kinds[0]}, line_id {kinds[1]}, score double, rank int")
    q = queries.select(F.col(query).alias("query_id"), G.char_gram_set(text).alias("g")).withColumn("qn", F.size("g"))
    r = lines.select(F.col(work).alias("work_id"), F.col(line).alias("line_id"), G.char_gram_set(line_text).alias("g")).withColumn("rn", F.size("g"))
    left = q.select("query_id", "qn", F.explode("g").alias("gram"))
    right = r.select("work_id", "line_id", "rn", F.explode("g").alias("gram"))
    shared = left.join(broadcast_if_small(right), "gram").groupBy("query_id", "work_id", "line_id").agg(F.count("*").alias("n"), F.first("qn").alias("qn"), F.first("rn").alias("rn"))
    scored = shared.withColumn("score", F.col("n") / F.least("qn", "rn")).filter(F.col("score") >= least)
    best = Window.partitionBy("query_id", "work_id").orderBy(F.desc("score"), "line_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "work_id", "line_id")
    one = scored.withColumn("r", F.row_number().over(best)).filter("r = 1")
    return one.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("query_id", "work_id", "line_id", "score", "rank")


def _trigram_ranks(q: DataFrame, words: list[str], ids: list, kind: str, top: int, ratio: tuple[float, float]) -> DataFrame:
    """(query_id, line_id, shared, rank) of :func:`trigram_candidates` against held lines, for many queries at once."""
    pairs = [(g, k) for k, t in enumerate(words) for g in grams_of(t, 3)]
    grams = sorted({g for g, _ in pairs})
    number = {g: k for k, g in enumerate(grams)}
    things, lines = np.array([number[g] for g, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)
    bags = WorkBags(things, lines, np.ones(len(pairs), np.int64), len(words), np.zeros(len(grams), np.int64))
    sent = q.sparkSession.sparkContext.broadcast((GramCodes(grams, 3), bags, np.array([len(t) for t in words], np.int64), ids))
    schema = f"query_id {q.schema[0].dataType.simpleString()}, line_id {kind}, shared long, rank int"
    arrow = q.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bags, lengths, ids = sent.value
        names, n, many = pa.array(ids, arrow.field("line_id").type), len(ids), len(bags.weight)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            for a, b in _lots(sizes.tolist(), 1 << 16, max(1, (1 << 20) // n)):
                rows, own = codes.ids(texts[a:b])
                keys = np.unique(rows * many + own)  # distinct grams
                shared = bags.scores(keys // many, keys % many, b - a).astype(np.int64)
                size = sizes[a:b, None]
                shared[(lengths < ratio[0] * size) | (lengths > ratio[1] * size)] = 0
                order = shared * n + np.arange(n - 1, -1, -1)  # of equal ones the first line
                best = np.argpartition(-order, top - 1, axis=1)[:, :top] if n > top else np.tile(np.arange(n), (b - a, 1))
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(order, best, 1), axis=1), 1)
                found = np.take_along_axis(shared, best, 1)
                at, rank = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(at), names.take(best[at, rank]), pa.array(found[at, rank]), pa.array((rank + 1).astype(np.int32))], schema=arrow)

    return q.mapInArrow(run, schema)


def trigram_candidates(queries: DataFrame, query: str, text: str, lines: DataFrame, line: str, line_text: str, top: int = 200, ratio: tuple[float, float] = (0.3, 3.0), texts: bool = True) -> DataFrame:
    """(query_id, line_id, shared, rank, q, t), without ``texts`` the first four: for each query the ``top`` lines by shared distinct trigrams, lengths within bounds.

    Counted against an index of the lines where those are small, else by an equi-join of trigrams.
    """
    q = queries.select(F.col(query).alias("query_id"), F.col(text).alias("q"))
    r = lines.select(F.col(line).alias("line_id"), F.col(line_text).alias("t"))
    if not texts and (held := held_lines(r.filter("t <> ''"), "line_id", "t")):
        return _trigram_ranks(q, [x["t"] for x in held], [x["line_id"] for x in held], r.schema["line_id"].dataType.simpleString(), top, ratio)
    if (held := held_lines(r.filter("t <> ''"), "line_id", "t")) is not None:
        words = [x["t"] for x in held]
        index = GramLines(words, 3), np.array([len(t) for t in words], np.int64), [x["line_id"] for x in held], words

        def answer(index, x: str) -> list[tuple]:
            grams, lengths, ids, words = index
            shared, _ = grams.shared(x)
            own = np.flatnonzero((shared > 0) & (lengths >= ratio[0] * len(x)) & (lengths <= ratio[1] * len(x)))
            if len(own) > top:  # all that share as much as the last one that is taken
                own = own[shared[own] >= np.partition(shared[own], -top)[-top]]
            own = own[np.argsort(-shared[own], kind="stable")][:top]
            if not texts:
                return list(zip([ids[k] for k in own.tolist()], shared[own].tolist(), range(1, len(own) + 1), strict=True))
            return [(ids[k], int(shared[k]), n + 1, x, words[k]) for n, k in enumerate(own)]

        return _per_text(q, index, answer, f"line_id {r.schema['line_id'].dataType.simpleString()}, shared long, rank int" + ", q string, t string" * texts)
    left = q.select("query_id", F.length("q").alias("ql"), F.explode(F.array_distinct(G.char_grams(F.col("q"), 3))).alias("gram"))
    right = r.select("line_id", F.length("t").alias("tl"), F.explode(F.array_distinct(G.char_grams(F.col("t"), 3))).alias("gram"))
    shared = left.join(broadcast_if_small(right), "gram").groupBy("query_id", "line_id").agg(F.count("*").alias("shared"), F.first("ql").alias("ql"), F.first("tl").alias("tl"))
    shared = shared.filter((F.col("tl") >= ratio[0] * F.col("ql")) & (F.col("tl") <= ratio[1] * F.col("ql")))
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "line_id")
    best = shared.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    if not texts:
        return best.select("query_id", "line_id", "shared", "rank")
    return best.join(q, "query_id").join(broadcast_if_small(r), "line_id").select("query_id", "line_id", "shared", "rank", "q", "t")


def adjacent_pairs(lines: DataFrame, work: str, line: str, text: str) -> DataFrame:
    """Every line and each line joined with its successor in the work, as one candidate table (line_id, work_id, text)."""
    order = Window.partitionBy(work).orderBy(line)
    after = lines.withColumn("after", F.lead(text).over(order)).filter("after IS NOT NULL")
    pairs = after.select(work, line, F.concat_ws(" ", text, "after").alias(text))
    return lines.select(work, line, text, F.lit(False).alias("paired")).unionByName(pairs.withColumn("paired", F.lit(True)))


def dealt(texts: DataFrame, *columns: str) -> DataFrame:
    """Written rows of few bytes and much work, dealt out: neither coalesced nor read by a task or two."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _answered(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query (query_id, q) with the answer (q, line_id, ratio) to its text; without one, a null line and ratio 0."""
    # Written first: the join then has exchanges of its own, which adaptive execution may split where a text is hot.
    out = queries.join(materialize(found, "answers"), "q", "left")
    return out.select("query_id", "line_id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def token_set_best(queries: DataFrame, query: str, text: str, lines: DataFrame, line: str, line_text: str, least: int = 4, block: int = LINES_BLOCK) -> DataFrame:
    """(query_id, line_id, ratio) for every query: of all lines of at least ``least`` characters the one with the best
    token-set ratio, ties by id; a null line and ratio 0 where the text has no words or there are no lines."""
    q = queries.select(F.col(query).alias("query_id"), F.col(text).alias("q"))
    r = lines.select(F.col(line).cast("long").alias("line_id"), F.col(line_text).alias("t")).filter(F.length("t") >= least)
    texts = dealt(materialize(q.select("q").distinct(), "texts"), "q")
    held = held_lines(r, "line_id", "t")

    def best_of(lines: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        parts = [[(x["line_id"], x["t"]) for x in lines[k : k + block]] for k in range(0, len(lines), block)]
        sent = q.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [M.TokenSetLines(p) for p in sent.value]
            for batch in batches:
                said = [x or "" for x in batch.column(0).to_pylist()]
                found = zip(*(s.bests(said) for s in scorers), strict=True) if scorers else ()
                best = [(x, *max(b, key=lambda y: (y[0], -y[1]))) for x, y in zip(batch.column(0).to_pylist(), found) if (b := [z for z in y if z])]
                columns = zip(*best, strict=True) if best else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.float64(), pa.int64()), strict=True)], ["q", "ratio", "line_id"])

        return run

    if held is not None:
        return _answered(q, texts.mapInArrow(best_of(held), "q string, ratio double, line_id long").select("q", "line_id", "ratio"))
    # Lines that no task can hold at once: a job for each part of them.
    lots, found = max(1, -(-r.count() // (50 * block))), None
    for i in range(lots):
        lot = r.filter(F.pmod(F.xxhash64("line_id"), F.lit(lots)) == i).collect()
        part = materialize(texts.mapInArrow(best_of(lot), "q string, ratio double, line_id long"), "best")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("q").agg(F.max(F.struct("ratio", (-F.col("line_id")).alias("neg"))).alias("b"))
    return _answered(q, best.select("q", (-F.col("b.neg")).alias("line_id"), F.col("b.ratio").alias("ratio")))


def sequence_best(queries: DataFrame, query: str, text: str, lines: DataFrame, work: str, line: str, line_text: str, top: int = 200, pairs: int = 50, ratio: tuple[float, float] = (0.3, 3.0)) -> DataFrame:
    """(query_id, line_id, ratio) for every query: the best matching-blocks ratio among the ``top`` lines by shared
    trigrams and, apart from them, the adjacent pairs of a work that the first ``pairs`` of those lines are part of.

    ``line_id`` is twice the (first) line's id, and one more for a pair; ties go to the smaller.  Texts of fewer than 3
    characters and those without candidates have a null line and ratio 0.
    """
    q = queries.select(F.col(query).alias("query_id"), F.col(text).alias("q"))
    texts = materialize(q.filter(F.length("q") >= 3).groupBy("q").agg(F.min("query_id").alias("rep")), "texts")
    r = lines.select(F.col(work).alias("work_id"), F.col(line).alias("line_id"), F.col(line_text).alias("t")).filter("t <> ''")
    if (held := held_lines(r, "line_id", "work_id", "t")) is not None:
        ids, words = [x["line_id"] for x in held], [x["t"] for x in held]
        after: list[int | None] = [None] * len(held)
        in_work = sorted(range(len(held)), key=lambda k: (held[k]["work_id"] is None, held[k]["work_id"], k))
        for a, b in zip(in_work, in_work[1:]):
            if held[a]["work_id"] == held[b]["work_id"]:
                after[a] = b
        before = {b: a for a, b in enumerate(after) if b is not None}
        heads = [k for k, b in enumerate(after) if b is not None]
        place = {k: len(held) + n for n, k in enumerate(heads)}
        # For each line the places among the choices of the pairs that it begins and ends; -1 for none.
        beside = np.array([[place.get(k, -1), place[before[k]] if k in before else -1] for k in range(len(held))], np.int64).reshape(-1, 2)
        choices = M.SequenceChoices([*words, *(f"{words[k]} {words[after[k]]}" for k in heads)], [*(2 * i for i in ids), *(2 * ids[k] + 1 for k in heads)])
        sent = q.sparkSession.sparkContext.broadcast((GramLines(words, 3), choices, beside))

        def near(grams: GramLines, choices: M.SequenceChoices, beside: np.ndarray, x: str) -> np.ndarray:
            fits = (choices.sizes >= ratio[0] * len(x)) & (choices.sizes <= ratio[1] * len(x))
            shared, _ = grams.shared(x)
            own = np.flatnonzero((shared > 0) & fits[: len(shared)])
            own = own[np.argsort(-shared[own], kind="stable")][:top]
            both = np.unique(beside[own[:pairs]])
            both = both[both >= 0]
            return np.concatenate([own, both[fits[both]]])

        def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, choices, beside = sent.value
            for batch in batches:
                said = batch.column(0).to_pylist()
                for a, b in _lots([len(x) for x in said], 1 << 18, 4_000):
                    found = choices.best(said[a:b], [near(grams, choices, beside, x) for x in said[a:b]])
                    yield _bests(batch.column(0).slice(a, b - a), found)

        return _answered(q, dealt(texts.select("q"), "q").mapInArrow(best_of, "q string, line_id long, ratio double"))
    near = materialize(trigram_candidates(texts, "rep", "q", lines, line, line_text, top, ratio).select("query_id", "line_id", "rank", "t"), "near")
    order = Window.partitionBy(work).orderBy(line)
    beside = lines.select(F.col(line).alias("line_id"), F.lag(line).over(order).alias("before"), F.lead(line).over(order).alias("after"), F.lag(line_text).over(order).alias("t_before"), F.lead(line_text).over(order).alias("t_after"))
    both = near.filter(F.col("rank") <= pairs).join(broadcast_if_small(beside), "line_id")
    ahead = F.struct((2 * F.col("line_id") + 1).alias("id"), F.concat_ws(" ", "t", "t_after").alias("t"), F.col("after").isNotNull().alias("real"))
    behind = F.struct((2 * F.col("before") + 1).alias("id"), F.concat_ws(" ", "t_before", "t").alias("t"), F.col("before").isNotNull().alias("real"))
    both = both.select("query_id", F.explode(F.array(ahead, behind)).alias("p")).filter("p.real").select("query_id", "p.id", "p.t").distinct()
    choices = near.select("query_id", (2 * F.col("line_id")).alias("id"), "t").unionByName(both).groupBy("query_id").agg(F.collect_list(F.struct("t", "id")).alias("c"))
    choices = choices.join(texts.withColumnRenamed("rep", "query_id"), "query_id").select("q", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, given = (c.to_pylist() for c in batch.columns)
            for a, b in _lots([len(x) for x in said], 1 << 18, 1_000):
                known = sorted({(y["t"], y["id"]) for c in given[a:b] for y in c})
                place = {x: k for k, x in enumerate(known)}
                fits = [[place[y["t"], y["id"]] for y in c if ratio[0] * len(x) <= len(y["t"]) <= ratio[1] * len(x)] for x, c in zip(said[a:b], given[a:b], strict=True)]
                found = M.SequenceChoices(*map(list, zip(*known, strict=True))).best(said[a:b], [np.array(f, np.int64) for f in fits])
                yield _bests(batch.column(0).slice(a, b - a), found)

    return _answered(q, dealt(choices, "q").mapInArrow(run, "q string, line_id long, ratio double"))


def _bests(q: pa.Array, found: list[tuple[float, int] | None]) -> pa.RecordBatch:
    """(q, line_id, ratio) of the answers to some texts."""
    return pa.RecordBatch.from_arrays([q, pa.array([f and f[1] for f in found], pa.int64()), pa.array([f[0] if f else 0.0 for f in found], pa.float64())], ["q", "line_id", "ratio"])
