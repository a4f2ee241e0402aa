"""Known texts in long recordings: which works are recited in one, and which line each of its words belongs to.

Both work on the recording's words by number.  What a place of a recording matches does not depend on what matched before
it, so all places are decided side by side; only the cursor that consumes matched words is sequential, and it is so between
places where it must stop anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.similarity import SequenceChoices, TextPlaces, code_points, common_subsequence
from quillspark.operators.retrieval import broadcast_if_small
from quillspark.operators.scans import running
from quillspark.plans.storage import materialize

#: Words of a recording that are joined with a line's words at once, and that one task matches at once.
BLOCK = 32
CHUNK = 256
#: Lines that a part of a recording is compared with in one row, about.
LINES = 64
#: Windows that a task compares with lines at once, about.
SIDE_BY_SIDE = 200_000
#: Characters of a line from which difflib leaves out frequent ones.
JUNK = 200
#: Size up to which an index of lines is sent to every task.
INDEX_BYTES = 32 << 20
#: Window sizes beside the number of a line's words, in the order in which equal scores go first.
SIZES = (0, 1, -1, 2)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text: runs of letters, marks and digits, A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def line_hits(recordings: DataFrame, rec: str, words: str, lines: DataFrame, work: str, line: str, line_words: str, share: float = 0.55, shortest: int = 5, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(rec, work, line, score, place): lines of which some window of as many words holds more than ``share``.

    score: the greatest Dice coefficient of the line's words and a window's, as multisets; a recording shorter than the
    line is one window.  place: the first such window that begins with a word of the line, or the last one of the
    recording.  Lines of fewer than ``shortest`` characters are never hit.  Null or empty words hit nothing; repeated rows
    of a recording are not told apart.

    Exact without comparing all pairs: a window above the share holds at least one of the line's rarest words, as many of
    them as may be missing and one more.  Lines without such a word in a recording, or with too few words there, are not
    looked at.  Lines whose words take up to ``index_bytes`` are sent to the recordings; else both sides are joined by word.
    """
    own = lines.select(F.col(work).alias("work"), F.col(line).alias("line"), F.col(line_words).alias("_w")).filter(F.length(F.array_join("_w", " ")) >= shortest)
    own = own.select("work", "line", F.size("_w").alias("n"), F.explode("_w").alias("word")).groupBy("work", "line", "n", "word").agg(F.count("*").alias("c"))
    own = materialize(own, "line_words")
    size = own.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    said = recordings.select(F.col(rec).alias("rec"), F.col(words).alias("words"))
    return _hits_in_tasks(said, own, share) if size <= index_bytes else _hits_by_joins(said, own, share)


class LineIndex:
    """Words of lines, and for each word the lines that have it, and those of whose rarest words it is one."""

    def __init__(self, rows: list[tuple[int, int, str, int]], share: float):
        """``rows``: (line, its number of words, word, how often)."""
        self.share, self.ids = share, {w: k for k, w in enumerate(sorted({r[2] for r in rows}))}
        line, n, word, count = (np.array(c, np.int64) for c in (zip(*((r[0], r[1], self.ids[r[2]], r[3]) for r in rows), strict=True) if rows else [[]] * 4))
        often = np.bincount(word, minlength=len(self.ids))
        order = np.lexsort((word, often[word], line))
        line, n, word, count = line[order], n[order], word[order], count[order]
        self.n = np.zeros(int(line.max()) + 1 if len(line) else 0, np.int64)
        self.n[line] = n
        before = np.cumsum(count) - count
        before -= before[np.searchsorted(line, line)]
        rare = before < n - np.floor(share * n)
        self.all = self._postings(word, line, count)
        self.rare = self._postings(word[rare], line[rare], count[rare])

    def _postings(self, word, line, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(len(self.ids) + 1)), line[order], count[order]

    @staticmethod
    def _expand(postings, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ids, line, count) of all postings of the ids."""
        starts, line, count = postings
        many = starts[ids + 1] - starts[ids]
        at = np.repeat(starts[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(np.arange(len(ids)), many), line[at], count[at]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for words that no line has."""
        return pc.fill_null(pc.index_in(words, value_set=pa.array(list(self.ids), words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def hits(self, words: np.ndarray, part: int = 1_000) -> list[tuple[int, float, int]]:
        """(line, score, place) of the lines that a recording's words, by number, hit; long recordings are gone through in parts."""
        best: dict[int, tuple[float, int]] = {}
        longest, m = int(self.n.max(initial=0)), len(words)
        for start in range(0, max(m, 1), part):
            for line, score, place in self._part(words[start : start + part + longest - 1], min(part, m - start) if start + part < m else m - start, m):
                if line not in best or score > best[line][0]:
                    best[line] = score, start + place
        return [(line, *b) for line, b in best.items()]

    def _part(self, words: np.ndarray, begins: int, m: int) -> Iterator[tuple[int, float, int]]:
        """The best windows that begin among the first ``begins`` words of this part of a recording of m words."""
        pos = np.flatnonzero(words >= 0)
        ids = words[pos]
        own, inverse, often = np.unique(ids, return_inverse=True, return_counts=True)
        # Lines longer than the recording have it as their one window; of others, a rarest word must be there.
        open_ = self.n > m
        open_[self._expand(self.rare, own)[1]] = True
        at, line, count = self._expand(self.all, own)
        held = np.bincount(line, np.minimum(count, often[at]), minlength=len(self.n))
        keep = (open_ & (2 * held > self.share * (self.n + np.minimum(self.n, m))))[line]
        postings = np.searchsorted(at[keep], np.arange(len(own) + 1)), line[keep], count[keep]
        at, line, count = self._expand(postings, inverse)
        if not len(at):
            return
        # A word counts in a window unless the line's share of it is taken by earlier ones there.
        order = np.lexsort((pos, ids))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        earlier = rank[at] - count
        same = (earlier >= 0) & (ids[order[earlier]] == ids[at])
        taken = np.where(same, pos[order[earlier]], -1)
        q, n = pos[at], self.n[line]
        low, high = np.maximum(np.maximum(q - n + 1, taken + 1), 0), np.minimum(q, np.maximum(len(words) - n, 0))
        wide = len(words) + 1
        inside = low <= high
        lows, highs = np.sort(line[inside] * wide + low[inside]), np.sort(line[inside] * wide + high[inside])
        here = high < begins
        line, n, high = line[here], n[here], high[here]
        code = line * wide + high
        held = np.searchsorted(lows, code, "right") - np.searchsorted(highs, code, "left")
        score = 2.0 * held / (n + np.minimum(n, m))
        order = np.lexsort((high, -score, line))
        order = order[np.diff(line[order], prepend=-1) != 0]
        for k in order[score[order] > self.share]:
            yield int(line[k]), float(score[k]), int(high[k])


def _hits_in_tasks(said: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """Recordings are read where they lie, by an index of the lines that a check has shown to be small."""
    held = own.orderBy("work", "line").collect()
    names = list(dict.fromkeys((r["work"], r["line"]) for r in held))
    number = {k: i for i, k in enumerate(names)}
    index = said.sparkSession.sparkContext.broadcast((LineIndex([(number[r["work"], r["line"]], r["n"], r["word"], r["c"]) for r in held], share), names))
    kinds = {**{f.name: f.dataType.simpleString() for f in own.schema}, "rec": said.schema["rec"].dataType.simpleString()}
    arrow = {f.name: f.type for f in [*said.limit(0).toArrow().schema, *own.limit(0).toArrow().schema]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, names = index.value
        for batch in batches:
            said = batch.column(1)
            ids, offsets = lines.numbers(said.values), said.offsets.to_numpy()  # a null list is an empty one
            out = [(rec, *names[k], score, place) for rec, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True) for k, score, place in lines.hits(ids[a:b])]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [arrow["rec"], arrow["work"], arrow["line"], pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rec", "work", "line", "score", "place"])

    found = said.mapInArrow(run, f"rec {kinds['rec']}, work {kinds['work']}, line {kinds['line']}, score double, place long")
    best = found.groupBy("rec", "work", "line").agg(F.max(F.struct("score", -F.col("place"))).alias("b"))
    return best.select("rec", "work", "line", "b.score", (-F.col("b.col2")).alias("place"))


def _hits_by_joins(said: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """The same by joins on words, for any number of lines."""
    said = said.select("rec", F.size("words").alias("m"), F.posexplode("words").alias("pos", "word"))
    # Words that no line has never count; what is left is all that the rest needs.
    said = materialize(said.join(broadcast_if_small(own.select("word").distinct()), "word", "left_semi"), "said")
    often = said.groupBy("word").agg(F.count("*").alias("_often"))
    fewest = F.floor(F.col("n") * (share / (2 - share))) + 1
    rare_first = Window.partitionBy("work", "line").orderBy("_often", "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = own.join(often, "word", "left").withColumn("_often", F.coalesce("_often", F.lit(0))).withColumn("_before", F.coalesce(F.sum("c").over(rare_first), F.lit(0)))
    rare = rare.filter(F.col("_before") <= F.col("n") - fewest).select("word", "work", "line", "n")
    reach = [F.floor((F.col("pos") + s * (F.col("n") - 1)) / BLOCK) for s in (-1, 1)]
    near = said.join(broadcast_if_small(rare), "word").select("rec", "work", "line", F.explode(F.sequence(*reach)).alias("_block")).distinct()
    blocks = said.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    found = near.join(blocks, ["rec", "_block"]).join(broadcast_if_small(own), ["work", "line", "word"])
    found = materialize(found.select("rec", "work", "line", "n", "m", "pos", "word", "c"), "near")
    start = F.greatest(F.least("pos", F.col("m") - F.col("n")), F.lit(0))
    starts = found.select("rec", "work", "line", "m", start.alias("place"), F.floor(start / F.col("n")).alias("_bin")).distinct()
    bin_ = F.floor(F.col("pos") / F.col("n"))
    inside = found.select("rec", "work", "line", "n", "pos", "word", "c", F.explode(F.array(bin_, bin_ - 1)).alias("_bin"))
    inside = starts.join(inside, ["rec", "work", "line", "_bin"]).filter((F.col("pos") >= F.col("place")) & (F.col("pos") < F.col("place") + F.col("n")))
    held = inside.groupBy("rec", "work", "line", "place", "word").agg(F.least(F.count("*"), F.first("c")).alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    held = held.groupBy("rec", "work", "line", "place").agg((2.0 * F.sum("k") / (F.first("n") + F.least(F.first("n"), F.first("m")))).alias("score"))
    best = held.filter(F.col("score") > share).groupBy("rec", "work", "line").agg(F.max(F.struct("score", -F.col("place"))).alias("b"))
    return best.select("rec", "work", "line", F.col("b.score").alias("score"), (-F.col("b.col2")).cast("long").alias("place"))


def confirmed_works(hits: DataFrame, lines: DataFrame, work: str, least: int = 2, sure: int = 3, part: float = 0.3) -> DataFrame:
    """(rec, work, hits, n_lines): works with ``sure`` lines hit, or ``least`` that are more than ``part`` of its lines.

    A work of fewer than ``least`` lines is never confirmed.
    """
    size = lines.groupBy(F.col(work).alias("work")).agg(F.count("*").alias("n_lines"))
    found = hits.groupBy("rec", "work").agg(F.count("*").alias("hits")).join(broadcast_if_small(size), "work").filter(F.col("n_lines") >= least)
    return found.filter((F.col("hits") >= sure) | ((F.col("hits") >= least) & (F.col("hits") / F.col("n_lines") > part))).select("rec", "work", "hits", "n_lines")


def _letters(words: list[str]) -> np.ndarray:
    """Running counts of the characters of words, in 64 classes."""
    counts = np.array([np.bincount([ord(c) % 64 for c in w], minlength=64) for w in words] or np.zeros((0, 64), int))
    return np.concatenate([np.zeros((1, 64), int), np.cumsum(counts, axis=0)])


class Part:
    """Words of a recording in which windows begin at the places from first up to last."""

    def __init__(self, words: list[str], breaks: np.ndarray, first: int, last: int):
        """A break before word k is counted in breaks[k]; a window may not have one inside."""
        self.words, self.breaks, self.first, self.last = words, breaks, first, last

    @cached_property
    def sums(self) -> np.ndarray:
        return _letters(self.words)

    def best(self, line: str, floor: float, common: float) -> Iterator[tuple[int, int, int, float]]:
        """(place, window, size, ratio) of the best window at each place, where one is above the floor.

        Bounds come before the matching blocks, which are a common subsequence of both texts: words in common, characters
        in common, both taken for all places at once, and the longest common subsequence.
        """
        own = line.split(" ")
        n, known = len(own), set(own)
        said = np.cumsum([0, *(w in known for w in self.words)])
        target, matcher, best = None, None, {}
        for window, more in enumerate(SIZES):
            size = n + more
            at = np.arange(self.first, min(self.last, len(self.words) - size + 1))
            if size < 1 or not len(at):
                continue
            at = at[(self.breaks[at + size - 1] == self.breaks[at]) & (said[at + size] - said[at] >= common * n)]
            if not len(at):
                continue
            if matcher is None:
                target, matcher = np.bincount([ord(c) % 64 for c in line], minlength=64), SequenceMatcher(None, "", line)
            held = self.sums[at + size] - self.sums[at]
            held[:, ord(" ")] += size - 1
            bounds = 2 * np.minimum(held, target).sum(axis=1) / (held.sum(axis=1) + len(line))
            for i, bound in zip(at.tolist(), bounds.tolist(), strict=True):
                least = best[i][3] if i in best else floor
                if bound <= least:
                    continue
                text = " ".join(self.words[i : i + size])
                if 2 * common_subsequence(text, line) / (len(text) + len(line)) <= least:
                    continue
                matcher.set_seq1(text)
                if (ratio := matcher.ratio()) > least:
                    best[i] = i, window, size, ratio
        yield from best.values()

    def lanes(self, lines: list[str], common: float) -> np.ndarray:
        """(number of the line, place, window, size) of all windows that have enough words in common with a line."""
        out = [np.zeros((4, 0), np.int64)]
        for n, line in enumerate(lines):
            own = line.split(" ")
            said = np.cumsum([0, *map(set(own).__contains__, self.words)])
            if not said[-1] and common:
                continue
            for window, more in enumerate(SIZES):
                size = len(own) + more
                at = np.arange(self.first, min(self.last, len(self.words) - size + 1)) if size > 0 else np.zeros(0, np.int64)
                at = at[(self.breaks[at + size - 1] == self.breaks[at]) & (said[at + size] - said[at] >= common * len(own))] if len(at) else at
                if len(at):
                    out.append(np.stack([np.full(len(at), n), at, np.full(len(at), window), np.full(len(at), size)]))
        return np.concatenate(out, axis=1)


def best_windows(parts: list[tuple[Part, list[str]]], lanes: list[np.ndarray], floor: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(number of the part, of the line, place, window, size, ratio) of the best windows of lines, less those that another line
    beats at the place; windows and lines of many parts are compared side by side."""
    texts: dict[str, int] = {}
    numbers = [np.array([texts.setdefault(t, len(texts)) for t in lines], np.int64) for _, lines in parts]
    words = [w for part, _ in parts for w in part.words]
    begins = np.cumsum([0, *(len(part.words) for part, _ in parts)])
    row = np.repeat(np.arange(len(parts)), [x.shape[1] for x in lanes])
    own, at, window, size = np.concatenate(lanes, axis=1)
    if not len(own):
        return
    line = np.concatenate([n[x[0]] for n, x in zip(numbers, lanes, strict=True)])
    at = at + begins[row]
    choices = SequenceChoices(list(texts), list(range(len(texts))))
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    known = choices.codes[np.minimum(code_points([" ".join(words)]), len(choices.codes) - 1)]
    masks = TextPlaces(choices.text, choices.sizes, choices.kinds)
    chars = starts[at + size] - 1 - starts[at]
    both = chars + choices.sizes[line]
    whole = np.zeros(len(line), np.int64)
    bound = 2 * masks.subsequences(known, starts[at], starts[at] + chars, line, whole, choices.sizes[line]) / both
    ratio, top = np.zeros(len(line)), np.full(len(words), floor)
    order = np.lexsort((-bound, at))
    first = np.zeros(len(line), bool)
    first[order[np.diff(at[order], prepend=-1) != 0]] = True
    for lot in (first, ~first):  # a place's likeliest window first; others only if they could do as well
        here = np.flatnonzero(lot & (bound > floor) & (bound >= top[at]))
        least = np.ceil(top[at[here]] * both[here] / 2 - 1e-9).astype(np.int64)
        found = masks.matched(known, starts[at[here]], starts[at[here]] + chars[here], line[here], whole[here], choices.sizes[line[here]], least)
        ratio[here] = 2.0 * found / both[here]
        np.maximum.at(top, at[here], ratio[here])
    kept = np.flatnonzero((ratio > floor) & (ratio >= top[at]))
    kept = kept[np.lexsort((window[kept], own[kept], at[kept]))]
    if len(kept):
        new = np.r_[True, (np.diff(own[kept]) != 0) | (np.diff(at[kept]) != 0)]
        for k in kept[new].tolist():
            yield int(row[k]), int(own[k]), int(at[k] - begins[row[k]]), int(window[k]), int(size[k]), float(ratio[k])


def match_places(words: DataFrame, lines: DataFrame, floor: float = 0.45, silence: float | None = None, common: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """(session, pos, size, score, work, line): at each word the best of the session's lines, where one is above the floor.

    ``words``: (session long, pos, word, start, end), numbered from 0; null words count as empty, times may be null.
    ``lines``: (session, work, line, text) with the lines that the session is compared with.  Windows have the line's
    number of words, one more, one less or two more; the score is the matching-blocks ratio of window and line.  Equal
    scores: the smaller (work, line), then the window in this order.  No window goes across a pause longer than
    ``silence``.  ``common``: the least share of the line's number of words that a window must have in common with it; 0
    compares every window with every line of the session, which takes time in proportion to both.  A task compares at most
    ``chunk`` words and the windows that begin there with some ``LINES`` lines at once.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    own = materialize(lines.select("session", F.col("work"), F.col("line"), text.alias("text")).filter("text <> ''").distinct(), "lines")
    longest = own.agg(F.max(F.size(F.split("text", " ")))).first()[0] or 0
    ahead = longest + max(SIZES)
    in_chunk = F.sequence(F.floor((F.greatest(F.col("pos") - ahead, F.lit(0))) / chunk), F.floor(F.col("pos") / chunk))
    words = words.join(own.select("session").distinct(), "session", "left_semi")
    parts = words.select("session", F.explode(in_chunk).alias("chunk"), F.struct("pos", F.coalesce("word", F.lit("")).alias("word"), "start", "end").alias("w"))
    parts = parts.groupBy("session", "chunk").agg(F.sort_array(F.collect_list("w")).alias("words"))
    parts = materialize(parts, "chunks")
    types = [own.schema[c].dataType.simpleString() for c in ("work", "line")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = arrow.names
        for batch in batches:
            out, waiting, many = [], [], 0
            for n, row in enumerate(zip(*batch.columns, strict=True)):  # one row's values at a time
                session, c, held, lot = (x.as_py() for x in row)
                low = held[0]["pos"]
                pause = [silence is not None and None not in (a["end"], b["start"]) and b["start"] - a["end"] > silence for a, b in zip(held, held[1:])]
                part = Part([w["word"] for w in held], np.cumsum([0, *pause]), max(c * chunk - low, 0), (c + 1) * chunk - low)
                for x in lot:
                    if len(x["text"]) >= JUNK:
                        out += [(session, low + i, size, ratio, x["work"], x["line"], window) for i, window, size, ratio in part.best(x["text"], floor, common)]
                lot = [x for x in lot if len(x["text"]) < JUNK]
                lanes = part.lanes([x["text"] for x in lot], common)
                many += lanes.shape[1]
                waiting.append((session, low, lot, part, lanes))
                if many > SIDE_BY_SIDE or n + 1 == batch.num_rows:
                    for k, l, i, window, size, ratio in best_windows([(w[3], [x["text"] for x in w[2]]) for w in waiting], [w[4] for w in waiting], floor):
                        session, low, lot = waiting[k][:3]
                        out.append((session, low + i, size, ratio, lot[l]["work"], lot[l]["line"], window))
                    waiting, many = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    lots = materialize(own.groupBy("session").agg(F.ceil(F.count("*") / LINES).alias("_lots")), "lots")
    lot = own.join(lots, "session").groupBy("session", F.pmod(F.xxhash64("work", "line", "text"), "_lots").alias("_lot")).agg(F.collect_list(F.struct("work", "line", "text")).alias("lot"))
    lot = materialize(lot.drop("_lot"), "lots")
    compared = parts.join(lot, "session").select("session", "chunk", "words", "lot")
    kinds = own.limit(0).toArrow().schema
    arrow = pa.schema([("session", pa.int64()), ("pos", pa.int64()), ("size", pa.int64()), ("score", pa.float64()), ("work", kinds.field("work").type), ("line", kinds.field("line").type), ("window", pa.int64())])
    found = compared.mapInArrow(run, f"session long, pos long, size long, score double, work {types[0]}, line {types[1]}, window long")
    best = found.groupBy("session", "pos").agg(F.min(F.struct(-F.col("score"), "work", "line", "window", "size")).alias("b"))
    return best.select("session", "pos", "b.size", (-F.col("b.col1")).alias("score"), "b.work", "b.line")


def consume(places: DataFrame) -> DataFrame:
    """Those of (session long, pos, size) that a cursor stops at which goes on behind each one that it takes.

    A place that no earlier span reaches over is always taken; the places from one such to the next are gone through in
    order, with no more state than the cursor.
    """
    places = materialize(places, "places")
    width = F.lit(places.agg(F.max("size")).first()[0] or 1)
    bin_ = F.floor(F.col("pos") / width)
    spans = places.select("session", F.col("pos").alias("_from"), (F.col("pos") + F.col("size")).alias("_to"), F.explode(F.array(bin_, bin_ + 1)).alias("_bin"))
    over = (F.col("_from") < F.col("pos")) & (F.col("_to") > F.col("pos"))
    covered = places.withColumn("_bin", bin_).join(spans, ["session", "_bin"]).filter(over).select("session", "pos").distinct()
    marked = places.join(covered.withColumn("_covered", F.lit(1)), ["session", "pos"], "left").withColumn("_head", F.col("_covered").isNull().cast("long"))
    numbered = running(marked.drop("_covered"), ["session"], ["pos"], lambda t: {"_run": t.column("_head").to_numpy()}, {"_run": 0})
    columns = places.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cursor = None, 0
        for batch in batches:
            taken = []
            for session, run, pos, size in zip(*(batch.column(c).to_pylist() for c in ("session", "_run", "pos", "size")), strict=True):
                if (session, run) != key:
                    key, cursor = (session, run), pos
                taken.append(pos >= cursor)
                cursor = pos + size if taken[-1] else cursor
            yield batch.select(columns).filter(pa.array(taken, pa.bool_()))

    dealt = numbered.repartition("session", "_run").sortWithinPartitions("session", "_run", "pos")
    return dealt.mapInArrow(go, places.schema)


def match_stream(words: DataFrame, lines: DataFrame, floor: float = 0.45, silence: float | None = None, common: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """(session, pos, n_words, start, end, score, confidence, work, line, raw_text): the spans of words that lines consume.

    The cursor stands at a session's first word; where a line matches (see ``match_places``), it takes the best window and
    goes on behind it, else it goes one word further.  start and end are those of the span's words, confidence is the
    mean of theirs (null words and values left out).
    """
    taken = consume(match_places(words, lines, floor, silence, common, chunk))
    taken = materialize(taken.select("session", F.col("pos").alias("_first"), F.col("size").cast("long").alias("n_words"), "score", "work", "line"), "taken")
    each = taken.withColumn("pos", F.explode(F.sequence("_first", F.col("_first") + F.col("n_words") - 1))).join(words.select("session", "pos", "word", "start", "end", "confidence"), ["session", "pos"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word")))), lambda x: x["word"]), " ")
    whole = each.groupBy("session", "_first", "n_words", "score", "work", "line").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence"), text.alias("raw_text")
    )
    return whole.select("session", F.col("_first").alias("pos"), "n_words", "start", "end", "score", "confidence", "work", "line", "raw_text")
