import json
import random

import pytest
from granary.streaming import events as E

LOG = [
    (0.0, "completed", None, 50, 1),
    (1.0, "phase", "measurement", None, None),
    (1.5, "submitted", None, None, None),
    (2.0, "completed", None, 100, 30),
    (3.0, "completed", None, 300, 10),
    (4.0, "phase", "shutdown", None, None),
    (5.0, "completed", None, 900, 7),
]
SCHEMA = "t double, event string, phase string, latency long, amount long"


def test_window_and_drain(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    r = E.window_summary(E.placed(df, E.phase_bounds(df, "measurement", "shutdown")), 3.0).first()
    assert (r.submitted, r.completed, r.drain, r.amount, r.p50, r.p95, r.per_minute) == (1, 2, 1, 40, 100, 300, 40.0)
    with pytest.raises(Exception, match="told just once"):
        E.phase_bounds(df.union(df), "measurement", "shutdown").collect()


def leases_of(rows):
    out = {}
    for b, kind, token, t in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        out[b] = E.lease_step(out.get(b, ("queued", None, 0.0, 0)), {"kind": kind, "token": token, "t": t}, 60.0)
    return {b: (s[0], s[1], s[3]) for b, s in out.items()}


EVENTS = [
    ("a", "claim", "w1", 0.0),
    ("a", "claim", "w2", 10.0),
    ("a", "complete", "w2", 20.0),
    ("a", "complete", "w1", 30.0),
    ("b", "claim", "w1", 0.0),
    ("b", "claim", "w2", 61.0),
    ("b", "complete", "w1", 62.0),
    ("c", "claim", "w1", 0.0),
    ("c", "fail", "w1", 1.0),
    ("c", "claim", "w1", 2.0),
    ("c", "fail", "w1", 3.0),
    ("c", "claim", "w1", 4.0),
    ("c", "fail", "w1", 5.0),
    ("d", "claim", "w1", 0.0),
    ("d", "release", "w1", 1.0),
]


def test_leases_as_table_and_as_stream(spark, tmp_path):
    want = leases_of(EVENTS)
    assert want == {"a": ("done", None, 1), "b": ("leased", "w2", 2), "c": ("split", None, 3), "d": ("queued", None, 0)}
    df = spark.createDataFrame(EVENTS, "batch string, kind string, token string, t double")
    assert {r.batch: (r.state, r.token, r.tries) for r in E.leases(df).collect()} == want
    (tmp_path / "in").mkdir()
    for k, some in enumerate((EVENTS[:6], EVENTS[6:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("batch", "kind", "token", "t"), e))) for e in sorted(some, key=lambda e: e[3])))
    stream = E.leases(E.stream_of(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("update").format("memory").queryName("lease_states_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("lease_states_out").collect():
        if r.batch not in got or r.tries >= got[r.batch][2]:
            got[r.batch] = (r.state, r.token, r.tries)
    assert set(got) == set(want)


def test_counts_by_watermark_and_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("k1", "2024-01-01T00:00:10"), ("k1", "2024-01-01T00:00:12"), ("k2", "2024-01-01T00:00:20"), ("k3", "2024-01-01T00:01:30")]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"key": k, "ts": t}) for k, t in rows))
    source = E.stream_of(spark, str(tmp_path / "in"), "key string, ts timestamp")
    once = E.replayed_once(source, "key", "ts", "1 minute")
    q = once.writeStream.format("memory").queryName("replays_out").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.key for r in spark.table("replays_out").collect()) == ["k1", "k2", "k3"]
    batch = E.counted(spark.read.schema("key string, ts timestamp").json(str(tmp_path / "in")), "ts", "1 minute", "1 minute")
    assert sorted(r.n for r in batch.collect()) == [1, 3]


def test_deadlines():
    assert E.deadline_action(5, 10, 20, False, False) is None
    assert E.deadline_action(10, 10, 20, False, False) == "stop"
    assert E.deadline_action(15, 10, 20, True, False) is None
    assert E.deadline_action(20, 10, 20, True, False) == "interrupt"
    assert E.deadline_action(20, 10, 20, True, True) is None


def test_folded_leases_equal_step_by_step(spark):
    rng = random.Random(8)
    rows = [(f"b{rng.randrange(40)}", rng.choice(["claim", "claim", "complete", "fail", "release"]), rng.choice(["w1", "w2"]), float(k * 7 % 400)) for k in range(400)]
    df = spark.createDataFrame(rows, "batch string, kind string, token string, t double")
    assert {r.batch: (r.state, r.token, r.tries) for r in E.leases(df).collect()} == leases_of(rows)
