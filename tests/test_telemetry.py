import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import memory as m
from lodeworks.operators import telemetry as t

T0 = dt.datetime(2025, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(1, at(0), "a", "x", 1.0), (2, at(0.4), "a", "x", 2.0), (3, at(0.9), "a", "y", 3.0), (4, at(2.5), "a", "x", 10.0), (5, at(0), "b", "x", None)]
    return spark.createDataFrame(rows, "id int, ts timestamp, u string, tool string, ms double")


def test_metrics(calls):
    got = t.tool_metrics(calls.where("u = 'a'").withColumn("tool", F.lit("z")), "tool", "ms", F.col("ms") < 5).first()
    assert (got.calls, got.errors, got.mean, got.p50) == (4, 1, 4.0, 2.5) and got.p95 == pytest.approx(8.95)


def test_windows(calls, rows):
    assert rows(t.idle_and_repeats(calls, "u", "ts", "id", "tool"), "id", "idle", "repeat") == [(1, None, 1), (2, 0.4, 2), (3, 0.5, 1), (4, 1.6, 1), (5, None, 1)]
    assert rows(t.sliding_count(calls, "u", "ts", 1.0), "id", "in_window") == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 1)]
    assert rows(t.sessions(calls, "u", "ts", "id", 1.0), "u", "n") == [("a", 1), ("a", 3), ("b", 1)]
    assert rows(t.running_mean(calls, "u", "ts", "id", "ms"), "id", "mean") == [(1, 1.0), (2, 1.5), (3, 2.0), (4, 4.0), (5, None)]
    assert rows(t.last_n(calls, "u", "ts", "id", 1), "id") == [(4,), (5,)]
    assert rows(t.idle_split(calls, "u", "ts", "id", 1.0)) == [("a", 0.9, 1.6), ("b", 0.0, 0.0)]


def test_trend_and_eta(spark):
    s = spark.createDataFrame([("p", at(60 * i), 100.0 + 20 * i) for i in range(5)] + [("q", at(0), 1.0)], "g string, ts timestamp, v double")
    got = {r.g: (r.slope, r.growing) for r in t.trend(s, "g", "ts", "v").collect()}
    assert got["p"] == (20.0, True) and got["q"][1] is False
    jobs = spark.createDataFrame([(100, 10.0, 1), (110, 20.0, 2), (90, 30.0, 3), (105, 40.0, 4), (5000, 1.0, 5)], "project_size bigint, duration_sec double, ts bigint")
    got = {r.size: r.eta for r in t.eta_similar(jobs, spark.createDataFrame([(100,), (7,), (5000,)], "size bigint")).collect()}
    assert got == {100: 30.0, 7: pytest.approx((1 + 40 + 30) / 3), 5000: 5.0}


def test_logs(spark, rows):
    lines = spark.createDataFrame([("2025-01-01T10:00:00 [error] [p] mod: went wrong: badly",), ("2025-01-02 09:00:00,5 [INFO] [q] m.n: ok",), ("garbage",), (None,)], "value string")
    p = t.parse_log(lines)
    assert rows(p.where("ts is not null"), "level", "project", "module", "message") == [("ERROR", "p", "mod", "went wrong: badly"), ("INFO", "q", "m.n", "ok")]
    assert rows(t.log_levels(p, F.lit("2025-01-02 09:30:00").cast("timestamp"))) == [("ERROR", 1), ("INFO", 1)]
    assert t.log_tail(p, 5).count() == 1


def test_memory(spark, rows):
    nodes = spark.createDataFrame([("a", "ACTIVE"), ("b", "REFUTED"), ("c", None), ("d", "SUPERSEDED")], "node_id string, status string")
    assert rows(m.visible(nodes), "node_id") == [("a",), ("c",)]
    log = spark.createDataFrame([("a", 1, "ACTIVE"), ("a", 2, "REFUTED"), ("a", 3, "ACTIVE"), ("b", 1, "REFUTED")], "k string, ts int, s string")
    assert rows(m.latest_state(log, "k", "ts", "s"), "k", "s") == [("a", "ACTIVE"), ("b", "REFUTED")]
    r = m.false_retractions(log, "k", "ts", "s").first()
    assert (r.retracted, r.restored, r.rate) == (2, 1, 0.5)
    anchors = spark.createDataFrame([("x", "file", "a.py"), ("x", "file", "b.py"), ("y", "file", "b.py"), ("z", "file", "a.py")], "k string, kind string, anchor string")
    present = spark.createDataFrame([("file", "a.py"), ("file", "a.py")], "kind string, anchor string")
    assert rows(m.verdicts(anchors, present, "k"), "k", "verdict") == [("x", "INCONCLUSIVE"), ("y", "NOT_FOUND"), ("z", "FOUND")]
    inc = spark.createDataFrame([(1, "cache lost rows again"), (2, "nothing alike")], "incident_id int, text string")
    assert rows(m.matching_incidents(inc, spark.createDataFrame([(9, "Rows lost in the cache")], "symptom_id int, text string"))) == [(9, 1, 3)]
    parts = spark.createDataFrame([("q", 1, "a", 5), ("q", 2, "b", 6), ("q", 3, "c", 1)], "g string, p int, k string, n int")
    assert rows(m.budgeted(parts, "g", "p", "k", "n", 11), "k") == [("a",), ("b",)]
