"""Which work is being performed: one step function per rule, shared by ordered replay and by stateful streams.

A step takes a session's state and one observation (time, hits) and returns what it emits; states are plain values, so a
replay over a bounded table and a stream with a state store run the same code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rules:
    """Smoothing, lock and pointer thresholds."""

    alpha: float = 0.35
    decay: float = 0.92
    floor: float = 0.05
    lock_score: float = 0.8
    lock_streak: int = 1
    unlock_score: float = 0.5
    unlock_misses: int = 3
    top: int = 5


@dataclass
class State:
    scores: dict[str, float] = field(default_factory=dict)
    locked: str | None = None
    streak_of: str | None = None
    streak: int = 0
    misses: int = 0
    pushed: str | None = None


def smooth(scores: dict[str, float], hits: list[tuple[str, float]], rules: Rules = Rules()) -> dict[str, float]:
    """All scores decay, those below the floor go; a known work blends towards its hit, a new one starts at the full hit."""
    kept = {w: s * rules.decay for w, s in scores.items() if s * rules.decay >= rules.floor}
    for work, score in hits:
        kept[work] = (1 - rules.alpha) * kept[work] + rules.alpha * score if work in kept else score
    return kept


def blend(scores: dict[str, float], hits: list[tuple[str, float]], heard: bool, rules: Rules = Rules()) -> dict[str, float]:
    """The other tracker: without text all scores decay; with text every work moves from its score (0 if new) to its summed hits."""
    if not heard:
        moved = {w: s * rules.decay for w, s in scores.items()}
    else:
        now: dict[str, float] = {}
        for work, score in hits:
            now[work] = now.get(work, 0.0) + score
        moved = {w: (1 - rules.alpha) * scores.get(w, 0.0) + rules.alpha * now.get(w, 0.0) for w in {**scores, **now}}
    return {w: s for w, s in moved.items() if s >= rules.floor}


def ranked(scores: dict[str, float], top: int) -> list[tuple[str, float]]:
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]


def step(state: State, hits: list[tuple[str, float]], rules: Rules = Rules()) -> dict:
    """One observation: smoothing, then lock or unlock, then a push if what is shown has changed."""
    state.scores = smooth(state.scores, hits, rules)
    best = ranked(dict(hits), 1)
    if state.locked is None:
        work, score = best[0] if best else (None, 0.0)
        if work is not None and score >= rules.lock_score:
            state.streak = state.streak + 1 if state.streak_of == work else 1
            state.streak_of = work
            if state.streak >= rules.lock_streak:
                state.locked, state.misses, state.pushed = work, 0, None
        else:
            state.streak, state.streak_of = 0, None
    else:
        own = max((s for w, s in hits if w == state.locked), default=0.0)
        state.misses = 0 if own >= rules.unlock_score else state.misses + 1
        if state.misses >= rules.unlock_misses:
            state.locked, state.misses, state.streak, state.streak_of, state.pushed = None, 0, 0, None, None
    leader = ranked(state.scores, 1)
    push = state.locked if state.locked is not None and state.locked != state.pushed else None
    state.pushed = state.locked if push else state.pushed
    return {"leader": leader[0][0] if leader else None, "score": leader[0][1] if leader else None, "locked": state.locked, "push": push}


@dataclass
class Pointer:
    """The line within a locked work, with its anti-jitter state."""

    line: int | None = None
    candidate: int | None = None
    seen: int = 0


def advance(pointer: Pointer, prefix: list[tuple[int, float]], overlap: list[tuple[int, float]], sure: float = 0.8, gap: float = 0.15, least: float = 0.15, margin: float = 0.04, jump: int = 4, jump_score: float = 0.75, confirm: int = 2, at_once: float = 0.9) -> int | None:
    """Move the pointer: a clear prefix match leads, else the best overlap (ties by line).

    A line other than the present one must beat the present one's overlap by ``margin``, needs a high score to be far off,
    and is believed at its ``confirm``-th sighting in a row, or at once if its score is very high.  Whatever else is seen
    ends the row of sightings.
    """
    top = sorted(prefix, key=lambda x: (-x[1], x[0]))
    clear = bool(top) and top[0][1] >= sure and top[0][1] - (top[1][1] if len(top) > 1 else 0.0) >= gap
    order = top if clear else sorted(overlap, key=lambda x: (-x[1], x[0]))
    candidate, seen, pointer.candidate, pointer.seen = pointer.candidate, pointer.seen, None, 0
    if not order or (not clear and order[0][1] < least):
        return pointer.line
    line, score = order[0]
    if pointer.line is not None and line != pointer.line:
        if score < dict(overlap).get(pointer.line, 0.0) + margin or (abs(line - pointer.line) > jump and score < jump_score):
            return pointer.line
        if score < at_once:
            seen = seen + 1 if candidate == line else 1
            if seen < confirm:
                pointer.candidate, pointer.seen = line, seen
                return pointer.line
    pointer.line = line
    return line


OUT = "session long, ts timestamp_ntz, event_id long, leader string, score double, locked string, push string"


def _observe(state: State, rows: pd.DataFrame, rules: Rules) -> list[tuple]:
    out = []
    for row in rows.sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
        found = step(state, [(row.work, float(row.score))], rules)
        out.append((row.session, row.ts, row.event_id, found["leader"], found["score"], found["locked"], found["push"]))
    return out


def replay(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every session's observations (session, ts, event_id, work, score) in order of time, by the shared step.

    A task holds one session at a time; sessions are independent.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_observe(State(), rows, rules), columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("session").applyInPandas(run, OUT)


class TrackerProcessor(StatefulProcessor):
    """The same step over a stream; a session's state is one JSON value in the state store."""

    rules = Rules()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("tracker", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(self._state.get()[0])) if self._state.exists() else State()
        batch = pd.concat(list(rows), ignore_index=True)
        out = _observe(state, batch, self.rules)
        self._state.update((json.dumps(asdict(state)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """The tracker over a streaming DataFrame; needs the RocksDB state store."""
    return events.groupBy("session").transformWithStateInPandas(statefulProcessor=TrackerProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums per fixed event-time window, for batches and streams alike."""
    rows = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")


def commit_and_carry(events: DataFrame, ts: str, width: str, slide: str, *keys: str) -> DataFrame:
    """Overlapping windows: each commits its width and carries its end into the next."""
    out = events.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")
