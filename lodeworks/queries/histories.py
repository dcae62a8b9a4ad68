"""Queries over change history, telemetry and the state of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import table
from lodeworks.operators import history as h
from lodeworks.operators import indexing as ix
from lodeworks.operators import memory as mem
from lodeworks.operators import telemetry as t
from lodeworks.queries.base import COMMITS_SQL, FILES_SQL, LISTED_SQL, commits, guard_files, listed_files

#: The test orders end in mid 1998; recency counts from then.
AS_OF = "1998-08-01"
MIN_COUPLING = 0.02


def cochange_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return h.cochange(commits(spark, sf), 3, MIN_COUPLING)


def pair_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return h.pair_frequency(commits(spark, sf), 4)


def change_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return h.file_risk(commits(spark, sf)).withColumn("last_change", F.date_format("last_change", "yyyy-MM-dd"))


def file_stability(spark: SparkSession, sf: str) -> DataFrame:
    return h.file_stability(commits(spark, sf)).withColumns({"first": F.date_format("first", "yyyy-MM-dd"), "last": F.date_format("last", "yyyy-MM-dd")})


def author_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return h.authors(commits(spark, sf))


def bug_totals(spark: SparkSession, sf: str) -> DataFrame:
    return h.bug_totals(commits(spark, sf))


def buggy_files(spark: SparkSession, sf: str) -> DataFrame:
    return h.buggy_files(commits(spark, sf))


def bug_recency_score(spark: SparkSession, sf: str) -> DataFrame:
    return h.bug_hotspots(commits(spark, sf), AS_OF).withColumn("last_bugfix", F.date_format("last_bugfix", "yyyy-MM-dd"))


def bug_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return h.bug_pairs(commits(spark, sf), 3)


def related_depth2(spark: SparkSession, sf: str) -> DataFrame:
    c = commits(spark, sf)
    pairs = h.pair_frequency(c, 4).select("file_a", "file_b", F.lit("cochange").alias("kind"), F.col("n").cast("double").alias("weight"))
    bugs = h.bug_pairs(c, 1).where("n >= 3").select("file_a", "file_b", F.lit("bug_correlation").alias("kind"), F.col("n").cast("double").alias("weight"))
    return h.related_files(h.knowledge_graph(pairs.unionByName(bugs)))


def significance_gate(spark: SparkSession, sf: str) -> DataFrame:
    return h.significance(commits(spark, sf), 0.5)


def similar_bugs(spark: SparkSession, sf: str) -> DataFrame:
    asks = spark.createDataFrame([("e1", "crash in the reader: cannot fix file"), ("e2", "api error while refactor")], "error_id string, text string")
    return h.similar_bugs(commits(spark, sf), asks, 10)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return h.decisions(commits(spark, sf))


def tool_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return t.tool_metrics(table(spark, sf, "events"), "event_type", "value", F.col("event_type") != "error")


def idle_and_repeat(spark: SparkSession, sf: str) -> DataFrame:
    at = t.idle_and_repeats(table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type")
    return at.select("event_id", F.coalesce("idle", F.lit(-1.0)).alias("idle"), F.col("repeat").cast("bigint").alias("repeat"))


def idle_split(spark: SparkSession, sf: str) -> DataFrame:
    return t.idle_split(table(spark, sf, "events"), "user_id", "ts", "event_id", 3600.0)


def _steps(name: str):
    """Five digits, cut where no mean of cents lies on the border, so both engines agree."""
    return (F.floor(F.col(name) * 1e5 + 0.3) / 1e5).alias(name)


def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    return t.running_mean(table(spark, sf, "events"), "event_type", "ts", "event_id", "value", 12).select("event_id", _steps("mean"))


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return t.last_n(table(spark, sf, "events"), "event_type", "ts", "event_id", 50).select("event_id", "event_type")


def sliding_rate(spark: SparkSession, sf: str) -> DataFrame:
    return t.sliding_count(table(spark, sf, "events"), "user_id", "ts", 86400.0).select("event_id", "in_window")


def session_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return t.sessions(table(spark, sf, "events"), "user_id", "ts", "event_id", 7200.0).select("user_id", F.col("session").cast("bigint").alias("session"), "n")


def daily_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return t.daily(table(spark, sf, "events"), "ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def trend_slope(spark: SparkSession, sf: str) -> DataFrame:
    at = t.trend(table(spark, sf, "events"), "event_type", "ts", "value", 0.0)
    return at.select("event_type", F.round(F.col("slope"), 5).alias("slope"), "peak")


def eta_blend(spark: SparkSession, sf: str) -> DataFrame:
    return t.eta_blend(table(spark, sf, "events"), "user_id", "ts", "event_id", "value", digits=12).select("event_id", _steps("eta"))


def eta_similar(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_size"), (F.col("o_totalprice") / 1000).alias("duration_sec"), F.col("o_orderkey").alias("ts"))
    return t.eta_similar(jobs, spark.createDataFrame([(10,), (100,), (1000000,)], "size bigint"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))
    at = t.parse_log(lines).where("ts is not null and level is not null")
    return at.groupBy("level", "project").agg(F.count("*").alias("n"))


def anti_drift(spark: SparkSession, sf: str) -> DataFrame:
    index = guard_files(spark, sf).groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
    return ix.drift(listed_files(spark, sf).select("file_path", "file_hash"), index)


def pruned_index(spark: SparkSession, sf: str) -> DataFrame:
    return ix.prune(guard_files(spark, sf), listed_files(spark, sf)).select("id", "file_path")


def upserted_index(spark: SparkSession, sf: str) -> DataFrame:
    old = guard_files(spark, sf).select("id", "file_path", "file_hash")
    new = old.where("file_path rlike '/core/'").select(F.concat("id", F.lit("_new")).alias("id"), "file_path", F.lit("x").alias("file_hash"))
    return ix.upsert_by_file(old, new)


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return ix.changed_files(listed_files(spark, sf).where("file_hash is not null"), guard_files(spark, sf)).select("file_path", "project")


def incident_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    incidents = docs.where(F.lower("source").rlike("^incident")).select(F.col("doc_id").alias("incident_id"), "text")
    symptoms = docs.where(F.lower("source").rlike("^adr")).select(F.col("doc_id").alias("symptom_id"), "text")
    return mem.matching_incidents(incidents, symptoms)


def rollup_cube_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    total = F.round(F.sum("o_totalprice"), 2).alias("total")
    parts = [o.rollup("o_orderstatus", "o_orderpriority").agg(total).withColumn("kind", F.lit("rollup")), o.cube("o_orderstatus", "o_orderpriority").agg(total).withColumn("kind", F.lit("cube"))]
    o.createOrReplaceTempView("_orders_sets")
    sets = spark.sql("select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as total, 'sets' as kind from _orders_sets group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
    return parts[0].unionByName(parts[1]).unionByName(sets)


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    named = [("union", c.union(s).distinct()), ("intersect", c.intersect(s)), ("except", c.subtract(s)), ("except_all", c.exceptAll(s))]
    out = None
    for name, df in named:
        part = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("op", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream through hourly windows; what the sink holds in the end."""
    from lodeworks.common import session_dir
    from lodeworks.streaming.events import rolling_metrics
    import uuid

    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(sf, pathGlobFilter="events.parquet")
    stream = rolling_metrics(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 hour")
    at = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "tool", "calls", F.round("mean", 6).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        cochange_matrix, pair_frequency, change_hotspots, file_stability, author_histogram, bug_totals, buggy_files, bug_recency_score, bug_pairs, related_depth2, significance_gate, similar_bugs, decisions,
        tool_metrics, idle_and_repeat, idle_split, running_mean, latest_events, sliding_rate, session_debounce, daily_histogram, trend_slope, eta_blend, eta_similar, log_lines,
        anti_drift, pruned_index, upserted_index, changed_files, incident_match, rollup_cube_sets, set_ops, stream_windows,
    )
}

_BUG = "regexp_matches(message, '(?i)\\b(fix|bug|hotfix|resolve|patch|workaround|correct|issue|defect|crash|error|broken)\\b')"
_CF = "(SELECT kf.hash, kf.file, k.message, k.date FROM kf JOIN k USING (hash))"
_PAIRS = "p AS (SELECT a.hash, a.file AS file_a, b.file AS file_b FROM kf a JOIN kf b ON a.hash = b.hash AND a.file < b.file)"
_GRAPH = f"""{_PAIRS}, r AS (SELECT file_a, file_b, count(*)::DOUBLE AS w FROM p GROUP BY ALL HAVING count(*) >= 4),
  bp AS (SELECT p.file_a, p.file_b, count(*) AS n FROM p JOIN k USING (hash) WHERE regexp_matches(message, '(?i)(fix|bug|hotfix|resolve|error|crash)') GROUP BY ALL HAVING count(*) >= 3),
  o AS (SELECT file_a, file_b, sum(w) AS weight FROM (SELECT * FROM r UNION ALL SELECT file_a, file_b, n * 2.0::DOUBLE FROM bp) GROUP BY ALL),
  gr AS (SELECT file_a AS src, file_b AS dst, weight FROM o UNION ALL SELECT file_b, file_a, weight FROM o)"""
_US = "epoch_us(ts)"

ORACLES = {
    "cochange_matrix": f"""WITH {COMMITS_SQL}, {_PAIRS}, n AS (SELECT file_a, file_b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT file, count(*) AS c FROM kf GROUP BY file)
        SELECT file_a, file_b, n, round(n / greatest(a.c, b.c), 3) AS coupling FROM n JOIN c a ON a.file = file_a JOIN c b ON b.file = file_b WHERE round(n / greatest(a.c, b.c), 3) >= {MIN_COUPLING}""",
    "pair_frequency": f"WITH {COMMITS_SQL}, {_PAIRS} SELECT file_a, file_b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 4",
    "change_hotspots": f"""WITH {COMMITS_SQL}, s AS (SELECT file, count(*) AS total, count(*) FILTER (regexp_matches(message, '(?i)(fix|bug|hotfix|resolve)')) AS bugfixes, CAST(CAST(max(date) AS DATE) AS VARCHAR) AS last_change FROM {_CF} GROUP BY file),
        r AS (SELECT *, round(bugfixes / total, 3) AS ratio FROM s) SELECT *, CASE WHEN ratio > 0.5 AND total >= 5 THEN 'high' WHEN ratio > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM r""",
    "file_stability": f"WITH {COMMITS_SQL} SELECT file, count(*) AS changes, CAST(CAST(min(date) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(date) AS DATE) AS VARCHAR) AS last, count(*) < 5 AS stable FROM {_CF} GROUP BY file",
    "author_histogram": f"WITH {COMMITS_SQL} SELECT author, count(*) AS commits FROM k GROUP BY author",
    "bug_totals": f"WITH {COMMITS_SQL} SELECT count(*) AS commits, count(*) FILTER ({_BUG}) AS bugfixes, round(count(*) FILTER ({_BUG}) / count(*), 3) AS ratio FROM k",
    "buggy_files": f"""WITH {COMMITS_SQL}, s AS (SELECT file, count(*) AS commits, count(*) FILTER ({_BUG}) AS bugfixes FROM {_CF} GROUP BY file)
        SELECT *, round(bugfixes / commits, 3) AS ratio, CASE WHEN bugfixes >= 3 THEN 'high' ELSE 'medium' END AS risk FROM s WHERE bugfixes > 0""",
    "bug_recency_score": f"""WITH {COMMITS_SQL}, s AS (SELECT file, count(*) AS bugs, max(CAST(date AS DATE)) AS last_bugfix FROM {_CF} WHERE {_BUG} GROUP BY file),
        a AS (SELECT *, date_diff('day', last_bugfix, DATE '{AS_OF}') AS age FROM s), r AS (SELECT file, bugs, last_bugfix, bugs * 2 + CASE WHEN age < 30 THEN 3 WHEN age < 90 THEN 1 ELSE 0 END AS score FROM a)
        SELECT file, bugs, CAST(last_bugfix AS VARCHAR) AS last_bugfix, score, CASE WHEN score >= 10 THEN 'critical' WHEN score >= 5 THEN 'high' ELSE 'medium' END AS risk FROM r""",
    "bug_pairs": f"""WITH {COMMITS_SQL}, {_PAIRS}, f AS (SELECT file_a, file_b, hash, message FROM p JOIN k USING (hash) WHERE regexp_matches(message, '(?i)(fix|bug|hotfix|resolve|error|crash)')),
        r AS (SELECT *, row_number() OVER (PARTITION BY file_a, file_b ORDER BY hash) AS rn FROM f)
        SELECT file_a, file_b, count(*) AS n, string_agg(message, ' | ' ORDER BY rn) FILTER (rn <= 3) AS messages FROM r GROUP BY ALL""",
    "related_depth2": f"""WITH {COMMITS_SQL}, {_GRAPH} SELECT src, dst, 1 AS depth, round(weight, 6) AS weight FROM gr
        UNION ALL SELECT a.src, b.dst, 2, round(max(sqrt(a.weight * b.weight)), 6) FROM gr a JOIN gr b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM gr c WHERE c.src = a.src AND c.dst = b.dst) GROUP BY ALL""",
    "significance_gate": f"""WITH {COMMITS_SQL}, t AS (SELECT file FROM kf GROUP BY file HAVING count(*) >= 3), n AS (SELECT hash, count(*) AS files, count(*) FILTER (file IN (SELECT file FROM t)) AS hot FROM kf GROUP BY hash),
        s AS (SELECT k.hash, CASE WHEN files >= 5 THEN 0.35 WHEN files >= 3 THEN 0.25 WHEN files >= 1 THEN 0.1 ELSE 0 END::DOUBLE
            + CASE WHEN regexp_matches(message || ' ' || body, '(?i)(fix|bug|hotfix|security|vulnerab|refactor|migrat|perf|race|deadlock|crash|regress|reindex)') THEN 0.3 ELSE 0 END::DOUBLE
            + CASE WHEN body <> '' THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN hot > 0 THEN 0.2 ELSE 0 END::DOUBLE AS s FROM k LEFT JOIN n USING (hash))
        SELECT hash, round(least(1, s), 2) AS score FROM s WHERE round(least(1, s), 2) >= 0.5""",
    "decisions": f"""WITH {COMMITS_SQL} SELECT hash, CASE WHEN starts_with(message, 'feat') THEN 'feature' WHEN starts_with(message, 'refactor') THEN 'refactor' ELSE 'other' END AS kind, message FROM k
        WHERE regexp_matches(message || ' ' || body, '(?i)(^feat\\(.*\\):|^refactor\\(.*\\):|^arch\\(.*\\):|^feat:|^refactor:|^arch:|^adr:|decision|replace|migrate|restructure|rewrite|redesign|extract|merge.*module|split.*module|change.*api|change.*interface)')""",
    "tool_metrics": """SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    "idle_and_repeat": f"""WITH a AS (SELECT *, lag({_US}) OVER w AS before, coalesce(CAST(lag(event_type) OVER w <> event_type AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a)
        SELECT event_id, round(coalesce(({_US} - before) / 1e6, -1), 6) AS idle, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS repeat FROM i""",
    "idle_split": f"""WITH a AS (SELECT user_id, round(({_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS idle FROM events)
        SELECT user_id, round(sum(CASE WHEN idle < 3600 THEN idle ELSE 0 END), 6) AS active, round(sum(CASE WHEN idle >= 3600 THEN idle ELSE 0 END), 6) AS idle FROM a GROUP BY user_id""",
    "running_mean": "SELECT event_id, floor(round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 12) * 1e5 + 0.3) / 1e5 AS mean FROM events",
    "latest_events": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50",
    "sliding_rate": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_US} RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "session_debounce": f"""WITH a AS (SELECT *, coalesce(CAST({_US} - lag({_US}) OVER w > 7200000000 AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM a) SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL""",
    "daily_histogram": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL",
    "trend_slope": f"""WITH a AS (SELECT event_type, value, {_US} / 1e6 - min({_US} / 1e6) OVER (PARTITION BY event_type) AS x FROM events)
        SELECT event_type, round(round(regr_slope(value, x) * 60, 6), 5) AS slope, max(value) AS peak FROM a GROUP BY event_type""",
    "eta_blend": "SELECT event_id, floor(round(0.3::DOUBLE * value + 0.7::DOUBLE * avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 12) * 1e5 + 0.3) / 1e5 AS eta FROM events",
    "eta_similar": """WITH w(size) AS (VALUES (10::BIGINT), (100::BIGINT), (1000000::BIGINT)), j AS (SELECT o_custkey AS project_size, o_totalprice / 1000 AS d, o_orderkey AS ts FROM orders),
        a AS (SELECT size, d, row_number() OVER (PARTITION BY size ORDER BY ts DESC) AS r FROM j, w WHERE abs(project_size - size) <= size * 0.2), l AS (SELECT size, d, row_number() OVER (PARTITION BY size ORDER BY ts DESC) AS r FROM j, w)
        SELECT size, round(greatest(5.0, coalesce((SELECT avg(d) FROM a WHERE a.size = w.size AND r <= 3), (SELECT avg(d) FROM l WHERE l.size = w.size AND r <= 3))), 6) AS eta FROM w""",
    "log_lines": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL),
        p AS (SELECT regexp_extract(v, '^(\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(?:[.,]\\d+)?)\\s+\\[(\\w+)\\]\\s+\\[([^\\]]*)\\]\\s+([^:]+):\\s*(.*)$', ['ts', 'level', 'project', 'module', 'message']) AS m FROM l)
        SELECT upper(m.level) AS level, m.project AS project, count(*) AS n FROM p WHERE m.level <> '' GROUP BY ALL""",
    "anti_drift": f"""WITH {FILES_SQL}, {LISTED_SQL}, i AS (SELECT file_path, max(file_hash) AS h FROM g GROUP BY file_path)
        SELECT coalesce(d.file_path, i.file_path) AS file_path, CASE WHEN i.file_path IS NULL THEN 'missing' WHEN d.file_path IS NULL THEN 'orphan' WHEN d.file_hash IS NOT DISTINCT FROM i.h THEN 'fresh' ELSE 'stale' END AS state
        FROM d FULL JOIN i ON d.file_path = i.file_path""",
    "pruned_index": f"WITH {FILES_SQL}, {LISTED_SQL} SELECT id, file_path FROM g WHERE file_path IN (SELECT file_path FROM d)",
    "upserted_index": f"""WITH {FILES_SQL} SELECT id, file_path, file_hash FROM g WHERE NOT regexp_matches(file_path, '/core/') UNION ALL SELECT id || '_new', file_path, 'x' FROM g WHERE regexp_matches(file_path, '/core/')""",
    "changed_files": f"WITH {FILES_SQL}, {LISTED_SQL} SELECT file_path, project FROM d WHERE file_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.file_path = d.file_path AND g.file_hash = d.file_hash)",
    "incident_match": """WITH w AS (SELECT DISTINCT doc_id, lower(source) AS s, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT doc_id AS incident_id, w FROM w WHERE starts_with(s, 'incident') AND length(w) > 3), a AS (SELECT doc_id AS symptom_id, w FROM w WHERE starts_with(s, 'adr') AND length(w) > 3)
        SELECT symptom_id, incident_id, count(*) AS common FROM a JOIN i USING (w) GROUP BY ALL HAVING count(*) >= 2""",
    "rollup_cube_sets": """SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, 'rollup' AS kind FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
        UNION ALL SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2), 'cube' FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
        UNION ALL SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2), 'sets' FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "set_ops": """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
        SELECT k, count(*) AS n, 'union' AS op FROM (SELECT k FROM c UNION SELECT k FROM s) GROUP BY k UNION ALL SELECT k, count(*), 'intersect' FROM (SELECT k FROM c INTERSECT SELECT k FROM s) GROUP BY k
        UNION ALL SELECT k, count(*), 'except' FROM (SELECT k FROM c EXCEPT SELECT k FROM s) GROUP BY k UNION ALL SELECT k, count(*), 'except_all' FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) GROUP BY k""",
}

ORACLES |= {
    "similar_bugs": f"""WITH {COMMITS_SQL}, w(error_id, words) AS (VALUES ('e1', ['crash', 'reader', 'fix', 'file']), ('e2', ['api', 'error', 'while', 'refactor'])),
        s AS (SELECT error_id, hash, CAST(len(list_filter(words, lambda x: contains(lower(message), x))) AS INTEGER) AS score FROM k, w WHERE regexp_matches(message, '(?i)(fix|bug|hotfix|resolve|error|crash|issue)')),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY error_id ORDER BY score DESC, hash) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 10""",
    "stream_windows": """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type AS tool, count(*) AS calls, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
        SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
}
