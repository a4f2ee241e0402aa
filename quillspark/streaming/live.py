"""Live segmentation: frames of a session go in, segments to be transcribed come out.

A frame is (session, ts, frame_id, ms, level): its length in milliseconds and its level, a loudness or a speech
probability.  One step function serves ordered replay and stateful streams; times are milliseconds since a session's start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MODES = ("vad", "fixed", "commit")
OUT = "session long, n long, seg_start long, seg_end long, reason string, level double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Cuts:
    """Fixed values, in milliseconds.  ``commit`` mode with cap 11000, commit 8000, carry 1500 is the rolling segmenter,
    with 12000, 10000, 2000 and a gate the commit-and-carry buffer."""

    mode: str = "vad"
    speech: float = 0.5
    most: int = 15_000
    least: int = 1_000
    silence: int = 600
    pre_roll: int = 200
    cap: int = 11_000
    commit: int = 8_000
    carry: int = 1_500
    gate: float | None = None
    drop_between: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES or min(self.most, self.cap, self.commit) <= 0 or self.commit > self.cap:
            raise ValueError(f"unusable cuts: {self}")


ROLLING = Cuts(mode="commit")
COMMIT_AND_CARRY = Cuts(mode="commit", cap=12_000, commit=10_000, carry=2_000)


@dataclass
class Held:
    """What a session holds back: frames [ms, level] from ``start`` on, and whether they are within speech."""

    start: int = 0
    frames: list = field(default_factory=list)
    size: int = 0
    speaking: bool = False
    quiet: int = 0
    n: int = 0

    def add(self, ms: int, level: float) -> None:
        self.frames.append([ms, level])
        self.size += ms

    def shed(self, ms: int) -> None:
        """Let go of the oldest ``ms`` milliseconds; a frame may be cut."""
        ms = max(min(ms, self.size), 0)
        self.start, self.size, gone = self.start + ms, self.size - ms, 0
        while gone < len(self.frames) and self.frames[gone][0] <= ms:
            ms -= self.frames[gone][0]
            gone += 1
        del self.frames[:gone]
        if ms:
            self.frames[0][0] -= ms

    def rms(self, ms: int) -> float:
        """Level of the oldest ``ms`` milliseconds."""
        total, left = 0.0, ms
        for length, level in self.frames:
            part = min(length, left)
            total, left = total + part * level * level, left - part
        return (total / ms) ** 0.5

    def out(self, ms: int, reason: str, level: float | None) -> tuple:
        self.n += 1
        return self.n - 1, self.start, self.start + ms, reason, level


def push(held: Held, ms: int, level: float, cuts: Cuts) -> list[tuple]:
    """(n, seg_start, seg_end, reason, level) of the segments that a frame closes.

    vad: speech opens a segment, with the pre-roll before it; silence closes it once it is long enough, or its greatest
    length does; level is its peak.  fixed: equal windows.  commit: a buffer beyond its cap commits its beginning, if
    that is loud enough for the gate, and keeps what was not committed, at least the carry; ``drop_between`` keeps the
    carry alone.  What is held at the end of a session is no segment.
    """
    closed = []
    if cuts.mode == "vad":
        loud = level >= cuts.speech
        if not held.speaking and not loud:
            held.add(ms, level)
            held.shed(held.size - cuts.pre_roll)
            return closed
        opens, held.speaking = not held.speaking, True
        held.add(ms, level)
        held.quiet = 0 if loud else held.quiet + ms
        if opens:  # the frame that opens a segment never closes it
            return closed
        silent = held.size >= cuts.least and held.quiet >= cuts.silence
        if silent or held.size >= cuts.most:
            closed.append(held.out(held.size, "silence" if silent else "length", max(x for _, x in held.frames)))
            held.shed(held.size - min(ms, cuts.pre_roll))
            held.speaking, held.quiet = False, 0
        return closed
    held.add(ms, level)
    if cuts.mode == "fixed":
        while held.size >= cuts.most:
            closed.append(held.out(cuts.most, "window", None))
            held.shed(cuts.most)
    elif held.size > cuts.cap:
        heard = held.rms(cuts.commit)
        if cuts.gate is None or heard >= cuts.gate:
            closed.append(held.out(cuts.commit, "commit", heard))
        kept = cuts.carry if cuts.drop_between else max(cuts.carry, held.size - cuts.commit)
        held.shed(held.size - kept)
    return closed


def _frame(ms, level) -> tuple[int, float]:
    """A null length is 0, a null level 0."""
    return int(ms) if ms == ms and ms is not None else 0, float(level) if level == level and level is not None else 0.0


def segments(frames: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Segments of every session, its frames in order of (ts, frame_id).

    A session passes through one task, frame by frame; a task holds the open segment of one session only, however long
    the session.  Empty tables give no rows; other columns are ignored; equal (ts, frame_id) may come in either order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current, begun = Held(), None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                session = None if row.session != row.session else row.session
                if not begun or session != current:
                    held, current, begun = Held(), session, True
                out += [(session, *x) for x in push(held, *_frame(row.ms, row.level), cuts)]
            yield pd.DataFrame(out, columns=_NAMES)

    rows = frames.select(F.col("session").cast("long").alias("session"), "ts", "frame_id", F.col("ms").cast("long").alias("ms"), F.col("level").cast("double").alias("level"))
    return rows.repartition("session").sortWithinPartitions("session", "ts", "frame_id").mapInPandas(run, OUT)


class LiveProcessor(StatefulProcessor):
    """The same step over a stream; a session's held frames are one JSON value in the state store."""

    def __init__(self, cuts: Cuts) -> None:
        self.cuts = cuts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = Held(**json.loads(self._state.get()[0])) if self._state.exists() else Held()
        out = []
        for row in pd.concat(list(rows), ignore_index=True).sort_values(["ts", "frame_id"], kind="stable").itertuples(index=False):
            out += [(key[0], *x) for x in push(held, *_frame(row.ms, row.level), self.cuts)]
        self._state.update((json.dumps(asdict(held)),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stream(frames: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Segments of a streaming DataFrame; needs the RocksDB state store."""
    rows = frames.select(F.col("session").cast("long").alias("session"), "ts", "frame_id", "ms", "level")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=LiveProcessor(cuts), outputStructType=OUT, outputMode="Append", timeMode="None")


def playhead_gate(arrivals: DataFrame, session: str, order: list[str], elapsed: str, received: str, width: float, lag: float = 3.0) -> DataFrame:
    """(session, n, win_end, released): windows of ``width`` seconds, each with the first ``elapsed`` at which it has been played.

    Played is what was received so far, but no more than the time elapsed less ``lag``; windows never run ahead of it.
    Null lengths count 0, rows without a time release nothing; windows that are never played give no row.
    """
    so_far = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = arrivals.withColumn("_got", F.sum(F.coalesce(F.col(received), F.lit(0.0))).over(so_far))
    played = F.greatest(F.lit(0.0), F.least("_got", F.col(elapsed) - lag))
    done = F.when(F.col(elapsed).isNotNull(), F.floor(played / width)).otherwise(F.lit(0))
    rows = rows.withColumn("_done", done).withColumn("_done", F.max("_done").over(so_far))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_done").over(Window.partitionBy(session).orderBy(*order)), F.lit(0)))
    rows = rows.filter("_done > _before").withColumn("n", F.explode(F.sequence(F.col("_before"), F.col("_done") - 1)))
    return rows.select(session, F.col("n").cast("long").alias("n"), ((F.col("n") + 1) * width).alias("win_end"), F.col(elapsed).alias("released"))
