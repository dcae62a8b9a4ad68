"""Telemetry of tool calls: events(ts, tool, ms, ok, ...), jobs, logs and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tool_metrics(events: DataFrame, tool: str, value: str, ok: Column) -> DataFrame:
    """Per tool: calls, errors, sum, least, most, true mean and interpolated p50, p95, p99."""
    p = [F.round(F.percentile(value, q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return events.groupBy(F.col(tool).alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(~ok).alias("errors"), F.round(F.sum(value), 6).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), *p
    )


def idle_and_repeats(events: DataFrame, group: str, ts: str, key: str, tool: str) -> DataFrame:
    """Each call with the seconds since the caller's last one and its place in a run of equal tools."""
    order = W.partitionBy(group).orderBy(ts, key)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) / 1e6
    at = events.withColumn("idle", F.round(gap, 6)).withColumn("_new", F.coalesce((F.lag(tool).over(order) != F.col(tool)).cast("int"), F.lit(1)))
    at = at.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return at.withColumn("repeat", F.row_number().over(W.partitionBy(group, "_island").orderBy(ts, key))).drop("_new", "_island")


def idle_split(events: DataFrame, group: str, ts: str, key: str, limit: float) -> DataFrame:
    """(group, active, idle) seconds by whether a gap stays below the limit."""
    at = idle_and_repeats(events.withColumn("_t", F.lit(0)), group, ts, key, "_t")
    return at.groupBy(group).agg(F.round(F.sum(F.when(F.col("idle") < limit, F.col("idle")).otherwise(0.0)), 6).alias("active"), F.round(F.sum(F.when(F.col("idle") >= limit, F.col("idle")).otherwise(0.0)), 6).alias("idle"))


def running_mean(events: DataFrame, group: str, ts: str, key: str, value: str, digits: int = 6) -> DataFrame:
    """Mean of the values so far per group."""
    w = W.partitionBy(group).orderBy(ts, key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("mean", F.round(F.avg(value).over(w), digits))


def last_n(events: DataFrame, group: str, ts: str, key: str, n: int) -> DataFrame:
    """The latest ``n`` rows per group."""
    order = W.partitionBy(group).orderBy(F.desc(ts), F.desc(key))
    return events.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def sliding_count(events: DataFrame, group: str, ts: str, seconds: float) -> DataFrame:
    """Calls of the group in the last so many seconds, this one included."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(group).orderBy("_us").rangeBetween(-int(seconds * 1e6), 0)
    return events.withColumn("_us", us).withColumn("in_window", F.count("*").over(w)).drop("_us")


def sessions(events: DataFrame, group: str, ts: str, key: str, gap_seconds: float) -> DataFrame:
    """(group, session, start, end, n): runs of events without a longer gap (T1 over a batch)."""
    order = W.partitionBy(group).orderBy(ts, key)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((us - F.lag(us).over(order) > int(gap_seconds * 1e6)).cast("int"), F.lit(1))
    at = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return at.groupBy(group, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def daily(events: DataFrame, ts: str) -> DataFrame:
    """(day, n, first, last)."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def trend(samples: DataFrame, group: str, ts: str, value: str, growing_above: float = 10.0) -> DataFrame:
    """(group, slope, peak, growing): least-squares slope per minute."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    start = F.min(seconds).over(W.partitionBy(group))
    at = samples.withColumn("_x", seconds - start)
    out = at.groupBy(group).agg(F.round(F.regr_slope(F.col(value), F.col("_x")) * 60, 6).alias("slope"), F.max(value).alias("peak"))
    return out.withColumn("growing", F.coalesce(F.col("slope") > growing_above, F.lit(False)))


def eta_similar(jobs: DataFrame, wanted: DataFrame, floor: float = 5.0) -> DataFrame:
    """(size, eta): mean of the last three jobs within 20 % of a size, else of the last three.

    jobs: (project_size, duration_sec, ts); wanted: (size), few rows, checked.
    """
    if wanted.limit(1001).count() > 1000:
        raise ValueError("at most 1000 sizes at a time")
    each = jobs.crossJoin(F.broadcast(wanted)).withColumn("near", F.abs(F.col("project_size") - F.col("size")) <= F.col("size") * 0.2)
    order = F.desc("ts")
    near = each.where("near").withColumn("r", F.row_number().over(W.partitionBy("size").orderBy(order, "duration_sec"))).where("r <= 3").groupBy("size").agg(F.avg("duration_sec").alias("a"))
    last = each.withColumn("r", F.row_number().over(W.partitionBy("size").orderBy(order, "duration_sec"))).where("r <= 3").groupBy("size").agg(F.avg("duration_sec").alias("b"))
    return last.join(near, "size", "left").select("size", F.round(F.greatest(F.lit(floor), F.coalesce("a", "b")), 6).alias("eta"))


def eta_blend(jobs: DataFrame, group: str, ts: str, key: str, value: str, last: int = 10, weight: float = 0.3, digits: int = 6) -> DataFrame:
    """Estimate after each job: ``weight`` of it and the rest of the mean of the last ones."""
    w = W.partitionBy(group).orderBy(ts, key).rowsBetween(-(last - 1), 0)
    return jobs.withColumn("eta", F.round(weight * F.col(value) + (1 - weight) * F.avg(value).over(w), digits))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, project, module, message) of "ts [LEVEL] [project] module: message"; other lines give nulls."""
    p = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?)\s+\[(\w+)\]\s+\[([^\]]*)\]\s+([^:]+):\s*(.*)$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(column, p, i), F.lit(""))

    stamp = F.try_to_timestamp(F.replace(F.replace(part(1), F.lit(","), F.lit(".")), F.lit("T"), F.lit(" ")))
    return lines.select(stamp.alias("ts"), F.upper(part(2)).alias("level"), part(3).alias("project"), part(4).alias("module"), part(5).alias("message"))


def log_levels(parsed: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(level, n) of the hours before ``as_of``."""
    recent = parsed.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr(f"interval {hours} hours")))
    return recent.groupBy("level").agg(F.count("*").alias("n"))


def log_tail(parsed: DataFrame, n: int, levels: tuple[str, ...] = ("ERROR", "WARNING")) -> DataFrame:
    """The latest lines of the given levels."""
    return parsed.where(F.col("level").isin(*levels)).orderBy(F.desc("ts"), "module", "message").limit(n)


def subquery_coverage(hits: DataFrame) -> DataFrame:
    """(file_path, queries) of files that several sub-queries found; hits: (query_id, file_path)."""
    return hits.groupBy("file_path").agg(F.count_distinct("query_id").alias("queries")).where("queries > 1")


def pressure(sample: Column, warn: float = 75.0, stop: float = 90.0) -> Column:
    """Band of a load in percent."""
    return F.when(sample >= stop, "critical").when(sample >= warn, "high").otherwise("normal")
