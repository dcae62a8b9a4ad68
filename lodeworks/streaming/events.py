"""Streams of file changes and tool calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def debounce_sessions(events: DataFrame, ts: str, project: str, path: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(project, start, end, files, n): bursts of changes in a project that a quiet gap ends."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), F.col(project).alias("project"))
        .agg(F.array_sort(F.collect_set(path)).alias("files"), F.count("*").alias("n"))
        .select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "files", "n")
    )


class Debounce(StatefulProcessor):
    """Flushes a project's changed files after a quiet gap, at a number of files, or at an age since the first event.

    Input (project, path, ts_ms), output (project, reason, files, n). Gaps and ages between events are those of
    their times. A burst after which no event comes is ended by a timer of the machine's clock, where the
    state machine runs with :func:`with_timers`; without timers it waits for the next event.
    """

    def __init__(self, quiet_ms: int = 500, most: int = 100, age_ms: int = 5000) -> None:
        self.quiet_ms, self.most, self.age_ms = quiet_ms, most, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "first bigint, last bigint, files array<string>")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        files = sorted(set(self.state.get()[2] or [])) if self.state.exists() else []
        self.state.clear()
        yield pd.DataFrame([(key[0], "quiet", files, len(files))] if files else [], columns=["project", "reason", "files", "n"])

    def _wait(self, timerValues, open_: bool) -> None:
        """One timer, a quiet gap from now, while a burst is open; none in a mode without timers."""
        now = timerValues.getCurrentProcessingTimeInMs()
        if now < 0:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if open_:
            self.handle.registerTimer(now + self.quiet_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, files = self.state.get() if self.state.exists() else (None, None, [])
        files = list(files or [])
        out = []

        def flush(reason: str) -> None:
            nonlocal first, last, files
            out.append((key[0], reason, sorted(set(files)), len(set(files))))
            first = last = None
            files = []

        events = sorted((int(t), p) for pdf in rows for p, t in zip(pdf["path"], pdf["ts_ms"], strict=True))
        for t, p in events:
            if files and t - last > self.quiet_ms:
                flush("quiet")
            elif files and t - first >= self.age_ms:
                flush("age")
            if not files:
                first = t
            last = t
            if p not in files:
                files.append(p)
            if len(files) >= self.most:
                flush("size")
        self.state.update((first, last, files))
        self._wait(timerValues, bool(files))
        yield pd.DataFrame(out, columns=["project", "reason", "files", "n"])

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """Admits at most ``limit`` calls of a key within any second; input (key, ts_ms), output (key, ts_ms, admitted)."""

    def __init__(self, limit: int, window_ms: int = 1000) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.state.get()[0] or []) if self.state.exists() else []
        out = []
        for t in sorted(int(t) for pdf in rows for t in pdf["ts_ms"]):
            recent = [x for x in recent if x > t - self.window_ms]
            fine = len(recent) < self.limit
            if fine:
                recent.append(t)
            out.append((key[0], t, fine))
        self.state.update((recent,))
        yield pd.DataFrame(out, columns=["key", "ts_ms", "admitted"])

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """Opens after failures in a row, tries again after a pause, closes after successes.

    Input (key, ts_ms, ok), output (key, ts_ms, state, allowed): the state before the call, and whether the call was let through.
    """

    def __init__(self, failures: int = 5, pause_ms: int = 30_000, successes: int = 1) -> None:
        self.failures, self.pause_ms, self.successes = failures, pause_ms, successes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, n int, since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, n, since = self.state.get() if self.state.exists() else ("CLOSED", 0, 0)
        out = []
        for t, ok in sorted((int(t), bool(o)) for pdf in rows for t, o in zip(pdf["ts_ms"], pdf["ok"], strict=True)):
            if state == "OPEN" and t - since >= self.pause_ms:
                state, n = "HALF_OPEN", 0
            allowed = state != "OPEN"
            out.append((key[0], t, state, allowed))
            if not allowed:
                continue
            if state == "CLOSED":
                n = 0 if ok else n + 1
                if n >= self.failures:
                    state, n, since = "OPEN", 0, t
            elif ok:
                n += 1
                if n >= self.successes:
                    state, n = "CLOSED", 0
            else:
                state, n, since = "OPEN", 0, t
        self.state.update((state, n, since))
        yield pd.DataFrame(out, columns=["key", "ts_ms", "state", "allowed"])

    def close(self) -> None:
        pass


DEBOUNCE_SCHEMA = "project string, reason string, files array<string>, n int"
RATE_SCHEMA = "key string, ts_ms bigint, admitted boolean"
BREAKER_SCHEMA = "key string, ts_ms bigint, state string, allowed boolean"


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    """A keyed state machine over a stream; needs the RocksDB state store."""
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")


def with_timers(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    """As :func:`with_state`, with timers of the machine's clock."""
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rolling_metrics(events: DataFrame, ts: str, tool: str, value: str, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, tool, calls, mean) in tumbling or sliding windows (T4)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "calls", "mean")


def reindexing(read_index: Callable[[], DataFrame], write_index: Callable[[DataFrame], None], parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces the rows of changed files (T5).

    The batch has (file_path, text); a null text is a deletion. A batch that comes twice leaves the same index.
    """
    from lodeworks.operators.indexing import upsert_by_file

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        write_index(upsert_by_file(read_index(), parse(batch.where("text is not null")), batch.select("file_path")))

    return apply
