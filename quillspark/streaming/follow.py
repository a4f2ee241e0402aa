"""Following a performance: the line within a known work, the tracker with its history, and throttled refreshes.

Each has a step that takes a session's state and one observation.  Over a bounded table, sessions are folded in order with
no more than that state in memory; over a stream the state lies in the state store, sessions that fall silent are ended by
an event-time timer, and rows behind the watermark are dropped.  What a step needs from the corpus is joined before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions import audio
from quillspark.functions import grams as G
from quillspark.operators.retrieval import broadcast_if_small
from quillspark.streaming import tracker

KEY = ["session", "ts", "event_id"]


def fold(rows: DataFrame, start: Callable[[], object], step: Callable[[object, dict], list[tuple]], out: str, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """What ``step`` gives for each row of a session in order of (ts, event_id), and ``end`` after its last one.

    The results follow the session's id in ``out``.  A task holds the state of one session at a time; rows stream through.
    """
    schema = rows.sparkSession.createDataFrame([], out).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if state is None or row["session"] != session:
                    found += [(session, *x) for x in end(state)] if end and state is not None else []
                    session, state = row["session"], start()
                found += [(session, *x) for x in step(state, row)]
            yield _batch(found, schema)
        if end and state is not None:
            yield _batch([(session, *x) for x in end(state)], schema)

    return rows.repartition("session").sortWithinPartitions(*KEY).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# The line within a work that is known.
POINTER = "session long, ts timestamp_ntz, event_id long, line long, moved boolean, trail array<long>"
#: Works up to which their lines are sent to every task.
WORKS = 20_000
#: Moves that a session remembers.
TRAIL = 40


@dataclass
class Followed:
    pointer: tracker.Pointer = field(default_factory=tracker.Pointer)
    trail: list[int] = field(default_factory=list)


def score_lines(observations: DataFrame, lines: DataFrame, text: Column | None = None, line_text: Column | None = None) -> DataFrame:
    """(session, ts, event_id, prefix, overlap): each observation scored against every line of its work.

    ``observations``: (session, ts, event_id, work, text), ``lines``: (work, line, text).  prefix: (line, score) of the
    first two words; overlap: (line, score) of 4-gram sets, those above 0.  Null texts and unknown works score nothing.
    """
    said = F.trim(F.coalesce(text if text is not None else F.col("text"), F.lit("")))
    two = lambda t: F.array_join(F.slice(F.filter(F.split(t, r"\s+"), lambda w: w != ""), 1, 2), " ")
    seen = observations.select(*KEY, "work", two(said).alias("_p"), G.char_gram_set(said).alias("_g"))
    own = F.trim(F.coalesce(line_text if line_text is not None else F.col("text"), F.lit("")))
    known = lines.select(F.col("work").alias("_work"), F.col("line").cast("long").alias("line"), two(own).alias("_q"), G.char_gram_set(own).alias("_h"))
    # A work's lines are one value: an observation meets them where it lies, and no row is made for a pair.
    known = known.groupBy("_work").agg(F.sort_array(F.collect_list(F.struct("line", "_q", "_h"))).alias("_lines"))
    both = seen.join(broadcast_if_small(known, WORKS), F.col("work") == F.col("_work"), "left")
    prefix = lambda x: F.when((F.col("_p") != "") & (x["_q"] != ""), G.prefix_score(x["_q"], F.col("_p")))
    overlap = lambda x: G.let(F.size(F.array_intersect(F.col("_g"), x["_h"])), lambda n: F.when(n > 0, n / F.least(F.size("_g"), F.size(x["_h"]))))
    scored = lambda s: F.filter(F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), s(x).alias("score"))), lambda x: x["score"].isNotNull())
    none = F.array().cast("array<struct<line:bigint,score:double>>")
    return both.select(*KEY, *(F.coalesce(F.sort_array(scored(s)), none).alias(n) for n, s in (("prefix", prefix), ("overlap", overlap))))


def point(state: Followed, row: dict) -> list[tuple]:
    """The pointer after an observation, whether it moved, and the last lines that it was moved to."""
    was = state.pointer.line
    pairs = {k: [(x["line"], x["score"]) for x in row[k]] for k in ("prefix", "overlap")}
    line = tracker.advance(state.pointer, pairs["prefix"], pairs["overlap"])
    if line != was:
        state.trail = [*state.trail, line][-TRAIL:]
    return [(row["ts"], row["event_id"], line, line != was, list(state.trail))]


def pointers(scored: DataFrame) -> DataFrame:
    """The pointer after each observation of a bounded table (see ``score_lines``)."""
    return fold(scored, Followed, point, POINTER)


# The tracker with its history.
TRACKED = "session long, ts timestamp_ntz, event_id long, work string, line long, line_score double, frozen boolean, candidates array<struct<work: string, score: double>>, history array<long>"


@dataclass(frozen=True)
class Settings:
    """Smoothing, the floor below which the pointer freezes, and how much is kept."""

    alpha: float = 0.35
    decay: float = 0.92
    floor: float = 0.05
    freeze: float = 0.45
    top: int = 5
    history: int = 40


@dataclass
class Tracked:
    scores: dict[str, float] = field(default_factory=dict)
    history: list[int] = field(default_factory=list)


def track(state: Tracked, row: dict, settings: Settings = Settings()) -> list[tuple]:
    """The leading work (ties by name), its best line, whether the evidence is too weak to move, candidates and history.

    ``row``: heard, and hits (work, line, score).  Without text all scores decay.  With text each work moves towards the
    sum of its hits; works below the floor go.  An observation whose best hit is above the freezing floor and that found a
    line of the leading work enters the history, which keeps the last ones.
    """
    hits = [(h["work"], h["line"], h["score"]) for h in ([] if row["hits"] is None else row["hits"])] if row["heard"] else []
    rules = tracker.Rules(alpha=settings.alpha, decay=settings.decay, floor=settings.floor)
    state.scores = tracker.blend(state.scores, [(w, s) for w, _, s in hits], bool(row["heard"]), rules)
    order = tracker.ranked(state.scores, settings.top)
    work, top = (order[0][0] if order else None), max((s for _, _, s in hits), default=0.0)
    found = [(s, -n) for w, n, s in hits if w == work]
    score, line = (max(found)[0], -max(found)[1]) if found else (0.0, -1)
    frozen = top < settings.freeze
    if found and not frozen:
        state.history = [*state.history, row["event_id"]][-settings.history :]
    return [(row["ts"], row["event_id"], work, line, score, frozen, [{"work": w, "score": s} for w, s in order], list(state.history))]


def tracked(observations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every observation (session, ts, event_id, heard, hits) of a bounded table, tracked; line is -1 where none is found.

    Null hits are none; lines are numbered from 0.
    """
    return fold(observations, Tracked, lambda state, row: track(state, row, settings), TRACKED)


# Throttled refreshes.
REFRESH = "session long, at timestamp_ntz, event_id long, reason string"


@dataclass
class Throttled:
    """The time of the last refresh, and the newest observation that waits for the next one; times are microseconds."""

    last: int | None = None
    waiting: int | None = None


def refresh(state: Throttled, ts: int, event_id: int, every: int) -> list[tuple[int, int, str]]:
    """(time, event_id, reason) of the refreshes up to and with an observation.

    An observation is shown at once if the last refresh was ``every`` ago; else it waits, and the newest that waits is shown
    when the time is up.
    """
    out = due(state, ts, every)
    if state.last is None or ts - state.last >= every:
        state.last = ts
        return [*out, (ts, event_id, "now")]
    state.waiting = event_id
    return out


def due(state: Throttled, now: int, every: int) -> list[tuple[int, int, str]]:
    """The refresh of what waits, if its time has come."""
    if state.waiting is None or now < state.last + every:
        return []
    state.last, event_id, state.waiting = state.last + every, state.waiting, None
    return [(state.last, event_id, "timer")]


def throttled(observations: DataFrame, every_s: float, loud: Column | None = None) -> DataFrame:
    """(session, at, event_id, reason) of a bounded table (session, ts, event_id): what is shown, at most once in ``every_s``.

    Observations for which ``loud`` (the level gate) does not hold never count, nor do those without a time.
    """
    every = round(every_s * 1e6)
    rows = observations.filter((loud if loud is not None else F.lit(True)) & F.col("ts").isNotNull())
    # Microseconds as a number: unix_micros wants a time with a zone, and the session's is UTC.
    rows = rows.select("session", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    out = fold(rows, Throttled, lambda s, r: refresh(s, r["ts"], r["event_id"], every), "session long, at long, event_id long, reason string", lambda s: due(s, 1 << 62, every))
    return out.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))


# A filter over blocks of samples.
FILTERED = "session long, ts timestamp_ntz, event_id long, samples array<double>"


def high_passed(blocks: DataFrame, cutoff: float, rate: float) -> DataFrame:
    """(session, ts, event_id, samples): blocks of samples in order, high-passed as if a session's blocks were one.

    The state that a block ends with is handed on to the session's next one.  Null blocks count as empty.
    """
    filter_ = audio.high_pass(cutoff, rate)

    def step(state: list, row: dict) -> list[tuple]:
        out, state[0] = audio.filtered(row["samples"] or [], state[0], filter_)
        return [(row["ts"], row["event_id"], out)]

    return fold(blocks, lambda: [(0.0, 0.0)], step, FILTERED)


# Streams.
class _Session(StatefulProcessor):
    """A session whose state ends when nothing came for ``idle_ms`` of event time: each batch moves its one timer on."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "at long")

    def _seen(self, rows: pd.DataFrame) -> None:
        newest = int(pd.to_datetime(rows["ts"]).max().value // 1_000_000) + self.idle_ms
        old = self.ends.get()[0] if self.ends.exists() else None
        if old is None or newest > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(newest)
            self.ends.update((newest,))

    def _rows(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        self._seen(batch)
        return batch

    def close(self) -> None:
        pass


class PointerProcessor(_Session):
    """``point`` with the pointer in a value state and the trail in a list state; an ended session gives a row with no line."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pointer = handle.getValueState("pointer", "line long, candidate long, seen long")
        self.trail = handle.getListState("trail", "line long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tracker.Pointer(*self.pointer.get()) if self.pointer.exists() else tracker.Pointer()
        state, out = Followed(held, [x[0] for x in self.trail.get()] if self.trail.exists() else []), []
        for row in self._rows(rows).to_dict("records"):
            out += [(key[0], *x) for x in point(state, row)]
        self.pointer.update((state.pointer.line, state.pointer.candidate, state.pointer.seen))
        if state.trail:
            self.trail.put([(x,) for x in state.trail])
        yield pd.DataFrame(out, columns=_names(POINTER))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.pointer, self.trail, self.ends):
            state.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, None, None, True, [])], columns=_names(POINTER))


class TrackedProcessor(_Session):
    """``track`` with the scores in a map state and the history in a list state."""

    def __init__(self, idle_ms: int, settings: Settings) -> None:
        super().__init__(idle_ms)
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.scores = handle.getMapState("scores", "work string", "score double")
        self.history = handle.getListState("history", "event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = Tracked(), []
        if self.scores.exists():
            state.scores = {k[0]: v[0] for k, v in self.scores.iterator()}
        if self.history.exists():
            state.history = [x[0] for x in self.history.get()]
        for row in self._rows(rows).to_dict("records"):
            out += [(key[0], *x) for x in track(state, row, self.settings)]
        self.scores.clear()
        for work, score in state.scores.items():
            self.scores.updateValue((work,), (score,))
        if state.history:
            self.history.put([(x,) for x in state.history])
        yield pd.DataFrame(out, columns=_names(TRACKED))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.scores, self.history, self.ends):
            state.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, None, None, -1, 0.0, True, [], [])], columns=_names(TRACKED))


class ThrottleProcessor(StatefulProcessor):
    """``refresh`` by the clock of the stream: event time, or the processing time of the task, which is when rows come.

    A timer stands for what waits; a state that is due for nothing within ``idle_ms`` goes with its time to live.
    """

    def __init__(self, every_ms: int, clock: str = "EventTime", idle_ms: int | None = None) -> None:
        self.every_ms, self.clock, self.idle_ms = every_ms, clock, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.idle_ms} if self.clock == "ProcessingTime" and self.idle_ms else {}
        self.state = handle.getValueState("throttle", "last long, waiting long", **ttl)

    def _show(self, key, found: list[tuple[int, int, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pd.Timestamp(at, unit="us"), e, r) for at, e, r in found], columns=_names(REFRESH))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Throttled(*self.state.get()) if self.state.exists() else Throttled()
        waited, out = state.waiting is not None and state.last, []
        for row in pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
            now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.clock == "ProcessingTime" else int(pd.Timestamp(row.ts).value // 1000)
            out += refresh(state, now, int(row.event_id), self.every_ms * 1000)
        waits = state.waiting is not None and state.last
        if waits != waited:
            if waited is not False:
                self.handle.deleteTimer(self._at(waited))
            if waits is not False:
                self.handle.registerTimer(self._at(waits))
        self.state.update((state.last, state.waiting))
        yield self._show(key, out)

    def _at(self, last: int) -> int:
        """Timers have milliseconds: the first one at which the refresh is due."""
        return -(-(last + self.every_ms * 1000) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = Throttled(*self.state.get()) if self.state.exists() else Throttled()
        out = due(state, expiredTimerInfo.getExpiryTimeInMs() * 1000, self.every_ms * 1000)
        self.state.update((state.last, state.waiting))
        yield self._show(key, out)

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += c
    return out


def stream(observations: DataFrame, processor: StatefulProcessor, out: str, watermark: str, clock: str = "EventTime") -> DataFrame:
    """A processor over a streaming DataFrame (session, ts, event_id, ...); rows behind the watermark are dropped.

    Needs the RocksDB state store.
    """
    rows = observations.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)  # watermarks want a zone: the session's, UTC
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=clock)
