"""Steps over tables and streams: replay equals stream, timers by a controlled clock, late rows and idle sessions."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import audio
from quillspark.streaming import follow, tracker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGIN = dt.datetime(2024, 1, 1)


def run_stream(spark, path, parts, schema, processor, out, watermark, name, clock="EventTime"):
    """Each part is a file and a micro-batch of its own, in order."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in" / f"part={k}"))
        files = list((path / "in" / f"part={k}").glob("*.parquet"))
        (path / "flat").mkdir(exist_ok=True)
        files[0].rename(path / "flat" / f"{k:04d}.parquet")
        import os

        os.utime(path / "flat" / f"{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "flat"))
    query = follow.stream(source, processor, out, watermark, clock).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return spark.table(name).collect(), query


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def plain(rows, *names):
    return sorted((tuple(str(r[n]) for n in names) for r in rows), key=str)


def test_pointer_rules():
    p = tracker.Pointer(line=3)
    assert tracker.advance(p, [], [(5, 0.5)]) == 3 and (p.candidate, p.seen) == (5, 1)
    assert tracker.advance(p, [], [(3, 0.5)]) == 3 and p.candidate is None  # the present line ends the row of sightings
    assert tracker.advance(p, [], [(5, 0.5)]) == 3 and tracker.advance(p, [], []) == 3 and p.seen == 0
    assert tracker.advance(p, [(9, 0.85), (3, 0.1)], [(3, 0.2)]) == 3 and tracker.advance(p, [(9, 0.85), (3, 0.1)], [(3, 0.2)]) == 9
    assert tracker.advance(p, [(1, 0.95), (9, 0.9)], [(9, 0.95)]) == 9  # the prefix is not clear
    assert tracker.advance(p, [(1, 0.95)], [(9, 0.95)]) == 9  # clear, but not better than the present line's overlap
    assert tracker.advance(p, [(1, 0.95)], [(9, 0.5)]) == 1


def test_scores_of_odd_observations(spark):
    seen = spark.createDataFrame([(1, at(0), 1, "w", "alpha beta gamma"), (1, at(1), 2, "w", None), (1, at(2), 3, "none", "alpha"), (2, at(0), 4, None, "  ")], "session long, ts timestamp_ntz, event_id long, work string, text string")
    lines = spark.createDataFrame([("w", 0, "alpha beta gamma delta"), ("w", 1, None), ("w", 2, "ਸਤਿ ਨਾਮੁ")], "work string, line long, text string")
    got = {r.event_id: (r.prefix, r.overlap) for r in follow.score_lines(seen, lines).collect()}
    assert [tuple(x) for x in got[1][0]] == [(0, 1.0), (2, 0.0)] and [x.line for x in got[1][1]] == [0]
    assert got[2] == ([], []) and got[3] == ([], []) and got[4] == ([], [])
    assert follow.pointers(follow.score_lines(seen.limit(0), lines)).count() == 0


def test_pointer_stream_equals_replay(spark, tmp_path):
    rng = random.Random(1)
    pair = lambda: [{"line": k, "score": round(rng.random(), 3)} for k in rng.sample(range(8), rng.randint(0, 4))]
    rows = [(s, at(10 * k + s), 100 * s + k, pair(), pair()) for s in range(3) for k in range(40)]
    schema = "session long, ts timestamp_ntz, event_id long, prefix array<struct<line: long, score: double>>, overlap array<struct<line: long, score: double>>"
    rows.sort(key=lambda r: r[1])
    parts = [rows[k : k + 30] for k in range(0, 120, 30)]
    names = ["session", "event_id", "line", "moved", "trail"]
    expected = plain(follow.pointers(spark.createDataFrame(rows, schema)).collect(), *names)
    got, _ = run_stream(spark, tmp_path, parts, schema, follow.PointerProcessor(idle_ms=3_600_000), follow.POINTER, "10 seconds", "pointer_stream")
    assert plain(got, *names) == expected and len({r[2] for r in expected}) > 2


def brute_track(rows):
    """The tracker's rules, with everything kept."""
    scores, history, out = {}, [], []
    for event, heard, hits in rows:
        hits = hits if heard else []
        inst = {}
        for w, _, s in hits:
            inst[w] = inst.get(w, 0.0) + s
        scores = {w: 0.65 * scores.get(w, 0.0) + 0.35 * inst.get(w, 0.0) if heard else 0.92 * scores[w] for w in {*scores, *inst}}
        scores = {w: s for w, s in scores.items() if s >= 0.05}
        lead = min(scores, key=lambda w: (-scores[w], w)) if scores else None
        best = min(((-s, n) for w, n, s in hits if w == lead), default=None)
        frozen = max((s for _, _, s in hits), default=0) < 0.45
        if best and not frozen:
            history = [*history, event]
        out.append((event, lead, best[1] if best else -1, frozen, history[-40:]))
    return out


def test_tracker_stream_drops_late_rows_and_ends_idle_sessions(spark, tmp_path):
    rng = random.Random(2)
    schema = "session long, ts timestamp_ntz, event_id long, heard boolean, hits array<struct<work: string, line: long, score: double>>"

    def row(session, second, event):
        hits = [(rng.choice("abc"), rng.randint(0, 9), round(rng.random(), 3)) for _ in range(rng.randint(0, 3))]
        return session, at(second), event, rng.random() < 0.9, [{"work": w, "line": n, "score": s} for w, n, s in hits]

    early = [row(1, 10 * k, k) for k in range(110)] + [row(2, 10 * k + 5, 1000 + k) for k in range(5)]
    late = [row(1, 100, 5000), row(2, 60, 5001)]  # the watermark of late rows is that of two batches ago
    after = [row(1, 1100 + 10 * k, 110 + k) for k in range(10)]
    last = [row(3, 5000, 9000)]  # moves the watermark on
    kept = [*early, *after, *last]
    # Session 2 is silent from 45 s on; session 1 from 1190 s on.
    by_session = {s: [(r[2], r[3], [(h["work"], h["line"], h["score"]) for h in r[4]]) for r in kept if r[0] == s] for s in (1, 2, 3)}
    expected = {x[0]: x[1:] for s in by_session for x in brute_track(by_session[s])}
    replay = {r.event_id: (r.work, r.line, r.frozen, r.history) for r in follow.tracked(spark.createDataFrame(kept, schema)).collect()}
    assert replay == expected and max(len(h) for *_, h in expected.values()) == 40
    got, query = run_stream(spark, tmp_path, [early, after, late, last], schema, follow.TrackedProcessor(300_000, follow.Settings()), follow.TRACKED, "0 seconds", "tracked_stream")
    assert {r.event_id: (r.work, r.line, r.frozen, r.history) for r in got if r.event_id is not None} == expected
    ended = {(r.session, r.ts) for r in got if r.event_id is None}
    assert ended == {(2, at(45 + 300)), (1, at(1190 + 300))}
    dropped = [o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(dropped) == 2


def brute_throttle(times, every):
    """Second by second: what is shown at each refresh."""
    out, last, waiting = [], None, None
    for t in range(times[-1][0] + every + 1):
        if waiting is not None and t == last + every:
            out.append((t, waiting, "timer"))
            last, waiting = t, None
        for at_, event in times:
            if at_ == t:
                if last is None or t - last >= every:
                    out.append((t, event, "now"))
                    last = t
                else:
                    waiting = event
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle_stream_equals_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    times, t = [], 0
    for event in range(80):
        t += rng.choice([0, 1, 2, 3, 12])
        times.append((t, event))
    schema = "session long, ts timestamp_ntz, event_id long, level double"
    rows = [(1, at(s), e, 1.0) for s, e in times]
    noise = [(1, at(3), 500, 0.1), (1, None, 501, 1.0)]
    expected = brute_throttle(times, 7)
    found = follow.throttled(spark.createDataFrame(rows + noise, schema), 7, F.col("level") >= 0.5).collect()
    assert sorted(((r["at"] - BEGIN).total_seconds(), r.event_id, r.reason) for r in found) == expected
    if seed == 0:
        parts = [rows[k : k + 20] for k in range(0, 80, 20)] + [[(2, at(10_000), 900, 1.0)]]
        got, _ = run_stream(spark, tmp_path, parts, schema, follow.ThrottleProcessor(7_000), follow.REFRESH, "0 seconds", "throttle_stream")
        assert sorted(((r["at"] - BEGIN).total_seconds(), r.event_id, r.reason) for r in got if r.session == 1) == expected


class Clock:
    """A state store's handle, a value state, timers and the time, all held by the test."""

    def __init__(self):
        self.now, self.value, self.timers, self.ttl = 0, None, set(), None

    def getValueState(self, name, schema, ttlDurationMs=None):
        self.ttl = ttlDurationMs
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.remove(t)
    getCurrentProcessingTimeInMs = lambda self: self.now
    getExpiryTimeInMs = lambda self: self.now

    def update(self, value):
        self.value = value


def test_throttle_by_a_controlled_clock():
    clock, processor = Clock(), follow.ThrottleProcessor(1_000, "ProcessingTime", idle_ms=60_000)
    processor.init(clock)
    assert clock.ttl == 60_000

    def rows(now, *events):
        clock.now = now
        batch = pd.DataFrame([(pd.Timestamp(BEGIN), e) for e in events], columns=["ts", "event_id"])
        return [(int(r.at.timestamp() * 1000), r.event_id, r.reason) for d in processor.handleInputRows((1,), iter([batch]), clock) for r in d.itertuples(index=False)]

    def timer(now):
        clock.now = now
        clock.timers.remove(now)
        return [(r.event_id, r.reason) for d in processor.handleExpiredTimer((1,), clock, clock) for r in d.itertuples(index=False)]

    assert rows(5_000, 1, 2) == [(5_000, 1, "now")] and clock.timers == {6_000}  # the second of the batch waits
    assert rows(5_500, 3) == [] and clock.timers == {6_000}
    assert timer(6_000) == [(3, "timer")] and clock.timers == set()
    assert rows(6_999, 4) == [] and clock.timers == {7_000}
    assert rows(7_400, 5) == [(7_000, 4, "timer")] and clock.timers == {8_000}  # the timer came late: the row finds it due
    assert timer(8_000) == [(5, "timer")]
    assert rows(20_000, 6) == [(20_000, 6, "now")] and clock.timers == set()


def test_high_pass_blocks_equal_the_whole(spark):
    rng = random.Random(3)
    signal = [5.0 + rng.random() for _ in range(500)]
    whole, state = audio.filtered(signal, (0.0, 0.0), audio.high_pass(100.0, 16_000.0))
    cuts = [0, 1, 7, 7, 130, 131, 400, 500]
    blocks = [(s, at(k), k, signal[a:b]) for s in (1, 2) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(3, at(0), 0, None), (3, at(1), 1, [None, 1.0])]
    found = follow.high_passed(spark.createDataFrame(blocks, "session long, ts timestamp_ntz, event_id long, samples array<double>"), 100.0, 16_000.0).collect()
    for s in (1, 2):
        assert [y for r in sorted(found, key=lambda r: r.event_id) if r.session == s for y in r.samples] == whole
    constant, _ = audio.filtered([1.0] * 20_000, (0.0, 0.0), audio.high_pass(100.0, 16_000.0))
    assert abs(constant[0] - 0.9726) < 1e-3 and abs(constant[-1]) < 1e-9  # what does not change is taken away
    assert [r.samples for r in found if r.session == 3][0] == []
    with pytest.raises(ValueError):
        audio.high_pass(9_000.0, 16_000.0)


def test_observations_are_scored_where_they_lie(spark):
    """No row is made or shuffled for an observation and a line."""
    seen = spark.createDataFrame([(1, at(0), 1, 1, "grey stone"), (1, at(1), 2, 9, None)], "session long, ts timestamp_ntz, event_id long, work long, text string")
    lines = spark.createDataFrame([(1, 1, "grey stone"), (1, 2, None), (1, 3, "green hills")], "work long, line long, text string")
    scored = follow.score_lines(seen, lines)
    assert {r.event_id: ([x.line for x in r.prefix], [x.line for x in r.overlap]) for r in scored.collect()} == {1: ([1, 3], [1]), 2: ([], [])}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session" not in plan
