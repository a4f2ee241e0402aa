from __future__ import annotations

from quillspark.streaming import tracker as K


def test_smoothing_seeds_and_decays():
    s = K.smooth({}, [("a", 0.9)])
    assert s == {"a": 0.9}
    s = K.smooth(s, [("b", 0.5)])
    assert abs(s["a"] - 0.828) < 1e-9 and s["b"] == 0.5
    for _ in range(60):
        s = K.smooth(s, [])
    assert s == {}


def test_lock_unlock_and_push():
    state = K.State()
    assert K.step(state, [("a", 0.9)])["push"] == "a"
    assert K.step(state, [("a", 0.9)])["push"] is None
    for _ in range(2):
        assert K.step(state, [("b", 0.9)])["locked"] == "a"
    assert K.step(state, [("b", 0.9)])["locked"] is None
    assert K.step(state, [("b", 0.9)])["push"] == "b"


def test_pointer():
    p = K.Pointer()
    assert K.advance(p, [], [(3, 0.5)]) == 3
    assert K.advance(p, [], [(4, 0.6), (3, 0.5)]) == 3
    assert K.advance(p, [], [(4, 0.6), (3, 0.5)]) == 4
    assert K.advance(p, [], [(20, 0.6)]) == 4


def test_replay_equals_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.selectExpr("user_id AS session", "ts", "event_id", "event_type AS work", "value / (abs(value) + 20) AS score")
    expected = {r.event_id: (r.leader, r.locked, r.push) for r in K.replay(rows).collect()}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = K.stream(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.event_id: (r.leader, r.locked, r.push) for r in spark.table("tracked").collect()} == expected
