import time
import uuid

import pytest

from lodeworks.streaming import events as ev


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a function over a stream of one file per batch and returns the rows it gave."""

    def run(schema, batches, plan, mode="append"):
        src = tmp_path / "in"
        src.mkdir()
        name = "t" + uuid.uuid4().hex
        stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            for i, rows in enumerate(batches):
                spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"w{i}"))
                part = next((tmp_path / f"w{i}").glob("part-*"))
                part.rename(src / f"{i}.json")
                q.processAllAvailable()
        finally:
            q.stop()
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_debounce(spark, feed):
    ev.use_rocksdb(spark)
    batches = [[("p", "a", 0), ("p", "b", 100), ("p", "a", 200)], [("p", "c", 1000)], [("p", f"x{i}", 2000 + 400 * i) for i in range(16)]]
    got = feed("project string, path string, ts_ms bigint", batches, lambda s: ev.with_state(s, "project", ev.Debounce(500, 100, 5000), ev.DEBOUNCE_SCHEMA))
    assert [(r[1], r[3]) for r in got] == [("quiet", 2), ("quiet", 1), ("age", 13)]


def test_the_last_burst_is_ended_by_a_timer(spark, tmp_path):
    ev.use_rocksdb(spark)
    (tmp_path / "in").mkdir()
    schema = "project string, path string, ts_ms bigint"
    spark.createDataFrame([("p", "a", 0), ("p", "b", 100), ("q", "c", 50)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = ev.with_timers(spark.readStream.schema(schema).json(str(tmp_path / "in")), "project", ev.Debounce(500, 100, 5000), ev.DEBOUNCE_SCHEMA)
    q = stream.writeStream.format("memory").queryName("last_burst").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("last_burst").count() < 2:
            time.sleep(1)
        assert sorted(tuple(r) for r in spark.table("last_burst").collect()) == [("p", "quiet", ["a", "b"], 2), ("q", "quiet", ["c"], 1)]
    finally:
        q.stop()


def test_rate_limit(spark, feed):
    ev.use_rocksdb(spark)
    got = feed("key string, ts_ms bigint", [[("k", 0), ("k", 10), ("k", 20)], [("k", 500), ("k", 1005), ("j", 0)]], lambda s: ev.with_state(s, "key", ev.RateLimit(2), ev.RATE_SCHEMA))
    assert sorted(got) == [("j", 0, True), ("k", 0, True), ("k", 10, True), ("k", 20, False), ("k", 500, False), ("k", 1005, True)]


def test_breaker(spark, feed):
    ev.use_rocksdb(spark)
    calls = [("k", 0, False), ("k", 1, False), ("k", 2, True), ("k", 50, True)]
    more = [("k", 102, False), ("k", 103, True), ("k", 300, True), ("k", 301, True)]
    got = sorted(feed("key string, ts_ms bigint, ok boolean", [calls, more], lambda s: ev.with_state(s, "key", ev.Breaker(2, 100), ev.BREAKER_SCHEMA)))
    assert [(r[1], r[2], r[3]) for r in got] == [(0, "CLOSED", True), (1, "CLOSED", True), (2, "OPEN", False), (50, "OPEN", False), (102, "HALF_OPEN", True), (103, "OPEN", False), (300, "HALF_OPEN", True), (301, "CLOSED", True)]


def test_windows_and_sessions(spark, feed, tmp_path):
    rows = [[("2025-01-01T00:00:00Z", "a", 1.0), ("2025-01-01T00:00:20Z", "a", 3.0)], [("2025-01-01T02:00:00Z", "a", 9.0)], [("2025-01-01T00:00:01Z", "a", 5.0)]]
    plan = lambda s: ev.rolling_metrics(s.withColumn("ts", s.ts.cast("timestamp")), "ts", "tool", "v")
    got = feed("ts string, tool string, v double", rows, plan)
    assert [(r[2], r[3], r[4]) for r in got] == [("a", 2, 2.0)]


def test_sessions(spark, feed):
    rows = [[("2025-01-01T00:00:00.0Z", "p", "a"), ("2025-01-01T00:00:00.3Z", "p", "b")], [("2025-01-01T00:10:00Z", "p", "c")]]
    got = feed("ts string, project string, path string", rows, lambda s: ev.debounce_sessions(s.withColumn("ts", s.ts.cast("timestamp")), "ts", "project", "path"))
    assert [(r[0], r[3], r[4]) for r in got] == [("p", ["a", "b"], 2)]


def test_reindexing(spark):
    state = {"index": spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "file_path string, text string")}
    apply = ev.reindexing(lambda: state["index"], lambda df: state.update(index=df), lambda df: df)
    batch = spark.createDataFrame([("a", "new"), ("b", None)], "file_path string, text string")
    for _ in range(2):
        apply(batch, 0)
    assert sorted((r.file_path, r.text) for r in state["index"].collect()) == [("a", "new"), ("c", "old")]
