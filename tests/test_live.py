from __future__ import annotations

import random

import pytest

from quillspark.functions import text as X
from quillspark.operators import align as A
from quillspark.plans import catalogue
from quillspark.sources import parsers
from quillspark.streaming import live

SF = "/root/testdata/sf0.001"
SCHEMA = "session long, ts long, frame_id long, ms long, level double"


def _speech(levels: list[float], cuts: live.Cuts, ms: int) -> list[tuple[int, int, str]]:
    """Speech segments of equal frames, by looking at all of a session at once."""
    out, i, free = [], 0, 0
    while i < len(levels):
        if levels[i] < cuts.speech:
            i += 1
            continue
        start = max(free, i * ms - cuts.pre_roll, 0)
        for j in range(i + 1, len(levels)):
            end = (j + 1) * ms
            quiet = next((j - k for k in range(j, i - 1, -1) if levels[k] >= cuts.speech), j + 1) * ms
            if (end - start >= cuts.least and quiet >= cuts.silence) or end - start >= cuts.most:
                out.append((start, end, "silence" if end - start >= cuts.least and quiet >= cuts.silence else "length"))
                i, free = j + 1, max(end - min(ms, cuts.pre_roll), 0)
                break
        else:
            break
    return out


@pytest.mark.parametrize("seed", range(20))
def test_speech_against_looking_back(seed):
    r = random.Random(seed)
    levels = [r.choice([0.0, 0.9]) if r.random() < 0.3 else (0.9 if (i // r.randint(3, 9)) % 2 else 0.1) for i in range(300)]
    cuts, held, out = live.Cuts(silence=300, least=500, most=2000, pre_roll=200), live.Held(), []
    for level in levels:
        out += [x[1:4] for x in live.push(held, 100, level, cuts)]
    assert out == _speech(levels, cuts, 100)


def test_segment_modes():
    held, out = live.Held(), []
    for ms in (4000, 30_000, 500):
        out += live.push(held, ms, 1.0, live.Cuts(mode="fixed"))
    assert [x[1:3] for x in out] == [(0, 15_000), (15_000, 30_000)] and held.size == 4500
    for drop, start in ((False, 8000), (True, 10_000)):
        held, out = live.Held(), []
        for _ in range(10):
            out += live.push(held, 2300, 1.0, live.Cuts(mode="commit", drop_between=drop))
        assert out[0][1:3] == (0, 8000) and out[1][1] == start, drop
    with pytest.raises(ValueError, match="unusable"):
        live.Cuts(mode="commit", cap=5, commit=9)


def test_replay_equals_stream_and_takes_odd_tables(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(1)
    rows = [(s, t, t, 100, r.random()) for s in (1, 2, 3) for t in range(200)]
    frames = spark.createDataFrame(rows, SCHEMA)
    cuts = live.Cuts(silence=200, least=300, most=2000)
    expected = sorted(map(tuple, live.segments(frames, cuts).collect()))
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = live.stream(source, cuts).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert expected and sorted(map(tuple, spark.table("cut").collect())) == expected
    assert live.segments(spark.createDataFrame([], SCHEMA), cuts).count() == 0
    odd = spark.createDataFrame([(None, 1, 1, None, None), (None, 2, 2, 900, 0.9), (None, 3, 3, 20_000, None)], SCHEMA).withColumn("n", live.F.lit("x"))
    assert [tuple(x) for x in live.segments(odd, cuts).collect()] == [(None, 0, 0, 20_900, "silence", 0.9)]


def _collapse(tokens: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(tokens):
        for size in range(8, 2, -1):
            phrase, n = tokens[i : i + size], 1
            while len(phrase) == size and tokens[i + n * size : i + (n + 1) * size] == phrase:
                n += 1
            if n >= 3:
                out, i = out + phrase, i + n * size
                break
        else:
            out, i = out + [tokens[i]], i + 1
    return out


def test_phrases_against_comparing_them(spark):
    r = random.Random(2)
    lists = [[r.choice("ab") for _ in range(r.randint(0, 40))] * r.randint(1, 4) for _ in range(300)] + [None, []]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    for row in rows.select("t", X.collapse_phrases("t").alias("c")).collect():
        assert row.c == (None if row.t is None else _collapse(row.t))
    for row in catalogue.phrase_collapse(spark, SF).join(spark.read.parquet(f"{SF}/conversations.parquet"), ["conv_id", "turn"]).collect():
        assert row.tokens == _collapse((row.text or "").split() * (1 + row.turn % 4))


def test_scripts(spark):
    rows = spark.createDataFrame([("क़ शः abc १।",), ("",), (None,), ("कa b",)], "t string")
    found = rows.select(X.devanagari_to_gurmukhi(live.F.col("t")), X.looks_devanagari(live.F.col("t"))).collect()
    assert [tuple(x) for x in found] == [("ਕ਼ ਸ਼ abc ੧।", True), ("", False), (None, False), ("ਕa b", False)]


def test_rescue_and_paths(spark):
    orphans = spark.createDataFrame([(1, 10, b) for b in ("aa", "bb", "cc", "c")] + [(2, 10, "aa"), (2, 10, "bb"), (3, 10, None)], "clip long, work long, bones string")
    index = spark.createDataFrame([(10, "aa"), (11, "aa"), (11, "aa"), (12, "bb"), (12, "cc"), (13, None)], "work_id long, bones string")
    assert [tuple(r) for r in A.rescue(orphans, "clip", "work", index).collect()] == [(1, 11, 2)]
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "x"]), (3, ["z", None]), (4, None)], "id long, c array<string>")
    listing = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "path string")
    assert {r.id: r.found for r in parsers.first_existing(rows, "id", live.F.col("c"), listing).collect()} == {1: "x", 2: "y", 3: None, 4: None}
