"""Queries of index upkeep, graph upkeep, context of symbols and files, and project memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import counting_rows, micros_of, table
from lodeworks.functions import text as tx
from lodeworks.operators import context as cx
from lodeworks.operators import graph as gr
from lodeworks.operators import history, indexing, memory, vector
from lodeworks.operators.chunking import module_of
from lodeworks.plans import search
from lodeworks.queries.base import CHUNKS_SQL, COMMITS_SQL, EDGES_SQL, FILES_SQL, LISTED_SQL, NODES_SQL, chunks, commits, guard_files, listed_files, live_edges, live_nodes

NOW_US = 1_767_225_600_000_000
PATTERNS = ["*.min.js", "scripts/", "/dense-orbit-13/tests", "docs/**/*.md"]


def moved_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every file under /core/ moves to /mcp/tools/."""
    rows = chunks(spark, sf).select("chunk_id", "file_path", "layer", F.lit("old").alias("module_name"))
    paths = rows.where("file_path is not null").select(indexing.clean_path("file_path").alias("old_path")).distinct().where("old_path like '%/core/%'")
    return indexing.moved(rows, paths.withColumn("new_path", F.replace("old_path", F.lit("/core/"), F.lit("/mcp/tools/"))))


def chunks_without_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks left when the files of the two smallest projects are taken out."""
    gone = listed_files(spark, sf).where("file_path like 'amber%' or file_path like 'brisk%'")
    return indexing.without_files(chunks(spark, sf).select("chunk_id", "file_path"), gone)


def safe_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "file_listing")
    at = counting_rows(rows, "file_path", micros_of(rows, "scanned_at"), r=F.struct("size_chars")).select("file_path", F.col("r.size_chars").alias("size_chars"))
    return at.select("file_path", F.coalesce(indexing.safe_to_index("file_path", "size_chars"), F.lit(False)).alias("safe"), indexing.ignored("file_path", PATTERNS).alias("ignored"))


def fitted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    at = rows.where(vector.not_zero("embedding")).select("vec_id", vector.fitted("embedding", 100).alias("v"), vector.fitted("embedding", 5).alias("w"))
    return at.select("vec_id", F.size("v").alias("n"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.col("v")[99].cast("double").alias("last"), F.size("w").alias("cut"))


def kept_in_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf)
    return indexing.time_range(rows, F.col("at_us"), NOW_US - 200 * 86_400_000_000, NOW_US - 60 * 86_400_000_000).select("chunk_id")


def index_age(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.staleness(chunks(spark, sf), F.col("at_us"), NOW_US).select(F.round("age", 3).alias("age"), "band")


def index_health(spark: SparkSession, sf: str) -> DataFrame:
    """A missing file warns, an orphan or stale one is critical."""
    disk = listed_files(spark, sf).select("file_path", "file_hash")
    state = indexing.drift(disk, guard_files(spark, sf).groupBy("file_path").agg(F.max("file_hash").alias("file_hash")))
    return indexing.health_rollup(state.select(F.col("file_path").alias("component"), F.when(F.col("state") == "missing", "warning").when(F.col("state") == "fresh", "info").otherwise("critical").alias("severity"), F.col("state").alias("message")))


def retained_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("written_at is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("written_at").cast("timestamp").alias("at"))
    return indexing.retained(docs, "source", "at", "2026-01-01 00:00:00", {"log_excerpt": 90, "chat_log": 200, "diary": 30}).select("doc_id")


def upserted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh edge comes again with another weight and a later id; ends must be live nodes."""
    old = live_edges(spark, sf).select("id", "source_id", "target_id", "type", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    new = old.where("id % 7 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "source_id", "target_id", "type", (F.col("weight") + 1).alias("weight"))
    return gr.upsert_edges(old, new, live_nodes(spark, sf)).select("id", F.round("weight", 6).alias("weight"))


def edges_after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left when every eleventh node goes."""
    n = live_nodes(spark, sf)
    return gr.delete_nodes(n, live_edges(spark, sf), n.where("id % 11 = 0").select("id"))[1].select("id")


def imported_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf).select("id", "qualified_name")
    return gr.merged_nodes(n.where("id % 2 = 0"), n.where("id % 2 <> 0")).select("id")


def renamed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf)
    top = n.where("name <> ''").groupBy("name").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "name").first()["name"]
    return gr.renamed(n, top, "renamed_one").where("name = 'renamed_one'").select("id", "name", "qualified_name")


def node_ranks(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf).where("properties is null or properties in ('{}', '{\"placeholder\": true}')")
    return n.select("id", gr.node_preference("name", "file_path", "properties", F.lit("merge_rank")).cast("int").alias("preference"), gr.call_confidence("name", "properties").alias("confidence"))


def shared_symbols(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf).where("name <> '' and file_path <> ''")
    return gr.shared_symbols(n.select(F.col("name").alias("symbol"), F.element_at(F.split("file_path", "/"), 1).alias("project")))


def node_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cx.find_nodes(live_nodes(spark, sf), "function", "rank", limit=20, offset=5).select("id", "name")


def symbol_context(spark: SparkSession, sf: str) -> DataFrame:
    return cx.symbol_context(live_nodes(spark, sf), live_edges(spark, sf))


def call_chain(spark: SparkSession, sf: str) -> DataFrame:
    """What calls the symbols of the name that is called most, two steps back."""
    n, e = live_nodes(spark, sf), live_edges(spark, sf)
    top = gr.of_type(e, "CALLS").join(n.where("name <> ''").select(F.col("id").alias("target_id"), "name"), "target_id").groupBy("name").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "name").first()["name"]
    return cx.call_chain(n, e, top, "incoming", 2).select("start", "node", "depth")


def cyclic_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes on cycles of imports, calls and usage of any length, with the smallest node of their component."""
    e = gr.of_type(live_edges(spark, sf), "IMPORTS", "CALLS", "USAGE")
    return gr.on_cycles(gr.links(e).select("src", "dst"))


def related_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Files and, for every path of even length, a test named after the file."""
    files = listed_files(spark, sf).select("file_path")
    named = files.where("length(file_path) % 2 = 0").select(F.concat(F.lit("t/test_"), F.lower(module_of("file_path")), F.lit("_more.py")).alias("file_path"))
    return cx.related_tests(files.unionByName(named))


def code_topology(spark: SparkSession, sf: str) -> DataFrame:
    return cx.topology(live_nodes(spark, sf), live_edges(spark, sf))


def trust_stamps(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).where(cx.real_result("text", "file_path"))
    return cx.stamped(rows, "file_path", "text").select("chunk_id", "trust")


def name_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth name with its third letter lost finds the names it is near to."""
    n = live_nodes(spark, sf).where("length(name) >= 6")
    lost = n.where("id % 50 = 0").select(F.concat(F.expr("substring(name, 1, 2)"), F.expr("substring(name, 4)")).alias("name"))
    return cx.nearest_names(lost, n.select("name"), 2)


def drifted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed files whose noted hash is no longer that of the disk; hashes of paths whose length is a multiple of three were noted wrong."""
    noted = guard_files(spark, sf).where("file_hash is not null").select(F.col("id").alias("doc"), F.col("file_path").alias("symbol"), F.when(F.length("file_path") % 3 == 0, F.concat(F.lit("zz"), "file_hash")).otherwise(F.col("file_hash")).alias("hash"))
    return cx.drifted(noted, listed_files(spark, sf).where("file_hash is not null").select(F.col("file_path").alias("symbol"), F.col("file_hash").alias("hash")))


def keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return cx.keyword_fallback(table(spark, sf, "documents"), "doc_id", "text", "the graph loader of nightly is reindex")


def relation_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf).where("file_path <> ''")
    at = live_edges(spark, sf).join(n.select(F.col("id").alias("source_id"), F.col("file_path").alias("file_a")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("file_path").alias("file_b")), "target_id")
    return cx.relation_summary(at.select("file_a", "file_b", F.col("type").alias("kind"), F.coalesce("weight", F.lit(1.0)).alias("weight")))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.struct(F.lit(f"s{i}").alias("query_id"), F.lit(w).alias("w")) for i, w in enumerate(("vector", "graph", "cache"))])
    return chunks(spark, sf).where("text is not null and file_path is not null").withColumn("q", F.explode(words)).where("contains(lower(text), q.w)").select("q.query_id", "file_path")


def subquery_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from lodeworks.operators.telemetry import subquery_coverage as covered

    return covered(_hits(spark, sf))


def subquery_relations(spark: SparkSession, sf: str) -> DataFrame:
    return cx.subquery_relations(_hits(spark, sf))


def enriched_results(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf)
    return search.enriched(gr.symbol_search(n, "rank", 20).select("id", F.col("name").alias("symbol_name"), F.lit(1).alias("rank")), n, live_edges(spark, sf)).select("id", "callers")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """States of graph nodes over their rows, as a memory log."""
    return table(spark, sf, "graph_nodes").where("id is not null").select("id", F.col("loaded_at").alias("ts"), F.when(F.col("removed_at").isNotNull(), "REFUTED").otherwise("ACTIVE").alias("status"))


def memory_states(spark: SparkSession, sf: str) -> DataFrame:
    return memory.status_distribution(memory.latest_state(_log(spark, sf), "id", "ts", "status"))


def memory_visible(spark: SparkSession, sf: str) -> DataFrame:
    return memory.visible(memory.latest_state(_log(spark, sf), "id", "ts", "status")).select("id")


def false_retractions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.false_retractions(_log(spark, sf), "id", "ts", "status")


def kept_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    now = memory.latest_state(_log(spark, sf), "id", "ts", "status")
    checked = now.select("id", F.when(F.col("id") % 3 == 0, "NOT_FOUND").otherwise("FOUND").alias("verdict"))
    return memory.stored_verdicts(now.select("id", "status"), checked, "id")


def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).where("text is not null and file_path is not null").withColumn("tokens", tx.token_estimate("text"))
    return memory.budgeted(rows, "file_path", "chunk_index", "chunk_id", "tokens", 300).select("chunk_id", "running")


def commit_search(spark: SparkSession, sf: str) -> DataFrame:
    return history.search_commits(commits(spark, sf), "CRASH", "s7", "1").select("hash", "author")


def embedding_canary(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth vector turned round counts as degraded."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = rows.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    return vector.canary(rows, after, "vec_id", "embedding").select("rows", F.round("mean_cosine", 4).alias("mean_cosine"), "degraded")


def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.size(tx.mentions("text")[1]).alias("mentions"))


QUERIES = {
    f.__name__: f
    for f in (
        moved_chunks, chunks_without_files, safe_files, fitted_vectors, kept_in_range, index_age, index_health, retained_documents, upserted_edges, edges_after_deletion, imported_nodes, renamed_symbols, node_ranks,
        shared_symbols, node_filter, symbol_context, call_chain, cyclic_imports, related_tests, code_topology, trust_stamps, name_suggestions, drifted_files, keyword_fallback, relation_summary, subquery_coverage,
        subquery_relations, enriched_results, memory_states, memory_visible, false_retractions, kept_verdicts, context_budget, commit_search, embedding_canary, mention_counts,
    )
}

_CLEAN = r"regexp_replace(replace({c}, '\', '/'), '^(\./)+', '')"
_G = f"{NODES_SQL}, {EDGES_SQL}"
_LOG = "l AS (SELECT id, loaded_at AS ts, CASE WHEN removed_at IS NOT NULL THEN 'REFUTED' ELSE 'ACTIVE' END AS status FROM graph_nodes WHERE id IS NOT NULL), s AS (SELECT id, arg_max(status, ts) AS status FROM l GROUP BY id)"
_HITS = "h AS (SELECT query_id, file_path FROM c, (VALUES ('s0', 'vector'), ('s1', 'graph'), ('s2', 'cache')) AS q(query_id, w) WHERE text IS NOT NULL AND file_path IS NOT NULL AND contains(lower(text), w))"
_TOP_NAME = "top AS (SELECT name FROM n WHERE name <> '' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"

ORACLES = {
    "moved_chunks": rf"""WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, file_path, layer, {_CLEAN.format(c="file_path")} AS p FROM c), y AS (SELECT *, replace(p, '/core/', '/mcp/tools/') AS q FROM x),
        z AS (SELECT *, '/' || lower(q) AS l FROM y)
        SELECT chunk_id, CASE WHEN contains(p, '/core/') THEN q ELSE file_path END AS file_path, CASE WHEN contains(p, '/core/') THEN regexp_replace(regexp_replace(q, '^.*/', ''), '\.[^.]*$', '') ELSE 'old' END AS module_name,
          CASE WHEN NOT coalesce(contains(p, '/core/'), false) THEN layer WHEN regexp_matches(l, '/tests?/|/test_[^/]*$|_test\.[a-z]+$') THEN 'tests' WHEN regexp_matches(l, '/docs?/|\.(md|rst)$') THEN 'docs'
            WHEN contains(l, '/scripts/') THEN 'scripts' ELSE 'mcp_tools' END AS layer FROM z""",
    "chunks_without_files": f"""WITH {CHUNKS_SQL}, {LISTED_SQL} SELECT chunk_id, file_path FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file_path = c.file_path AND (starts_with(d.file_path, 'amber') OR starts_with(d.file_path, 'brisk')))""",
    "safe_files": r"""WITH f AS (SELECT file_path, arg_max(struct_pack(s := size_chars), scanned_at).s AS size FROM file_listing WHERE file_path IS NOT NULL GROUP BY file_path)
        SELECT file_path, coalesce(regexp_matches(lower(file_path), '\.(py|js|jsx|ts|tsx|go|rs|java|c|h|cpp|hpp|cs|rb|php|md|rst|txt|json|toml|yaml|yml|ipynb)$') AND NOT regexp_matches(file_path, '\.min\.[a-z]+$')
          AND len(list_intersect(string_split(file_path, '/')[1:-2], ['.git', '.hg', '.svn', 'node_modules', '__pycache__', '.venv', 'venv', '.tox', '.mypy_cache', '.pytest_cache', 'dist', 'build', '.idea', '.vscode', 'target'])) = 0
          AND size <= 1048576, false) AS safe,
          regexp_matches(file_path, '(^|/)[^/]*\.min\.js(/|$)') OR contains('/' || file_path, '/scripts/') OR file_path = 'dense-orbit-13/tests' OR starts_with(file_path, 'dense-orbit-13/tests/')
          OR regexp_matches(file_path, '^docs/(.*/)?[^/]*\.md(/|$)') AS ignored FROM f""",
    "fitted_vectors": "SELECT vec_id, 100 AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, coalesce(CAST(embedding[100] AS DOUBLE), 0) AS last, 5 AS cut FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) >= 1e-9",
    "kept_in_range": f"WITH {CHUNKS_SQL} SELECT chunk_id FROM c WHERE at_us BETWEEN {NOW_US - 200 * 86_400_000_000} AND {NOW_US - 60 * 86_400_000_000}",
    "index_age": f"WITH {CHUNKS_SQL}, a AS (SELECT ({NOW_US} - max(at_us)) / 1e6 AS age FROM c) SELECT round(CAST(age AS DOUBLE), 3) AS age, CASE WHEN age > 3600 THEN 'old' WHEN age > 600 THEN 'aging' ELSE 'fresh' END AS band FROM a",
    "index_health": f"""WITH {FILES_SQL}, {LISTED_SQL}, i AS (SELECT file_path, max(file_hash) AS h FROM g GROUP BY file_path),
        b AS (SELECT CASE WHEN i.file_path IS NULL THEN 'warning' WHEN d.file_path IS NULL OR d.file_hash IS DISTINCT FROM i.h THEN 'critical' ELSE 'info' END AS s FROM d FULL JOIN i ON d.file_path = i.file_path)
        SELECT count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'warning') AS warnings, count(*) AS checks,
          CASE WHEN count(*) FILTER (s = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (s = 'warning') > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM b""",
    "retained_documents": """SELECT doc_id FROM documents WHERE written_at IS NOT NULL AND date_diff('day', CAST(written_at AS DATE), DATE '2026-01-01') <= CASE source WHEN 'log_excerpt' THEN 90 WHEN 'chat_log' THEN 200 WHEN 'diary' THEN 30 ELSE 1000000 END""",
    "upserted_edges": f"""WITH {_G}, a AS (SELECT id, source_id, target_id, type, coalesce(weight, 0) AS weight FROM e UNION ALL SELECT id + 1000000000, source_id, target_id, type, coalesce(weight, 0) + 1 FROM e WHERE id % 7 = 0),
        w AS (SELECT a.* FROM a WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))
        SELECT max(id) AS id, round(arg_max(weight, id), 6) AS weight FROM w GROUP BY source_id, target_id, type""",
    "edges_after_deletion": f"WITH {_G}, g AS (SELECT id FROM n WHERE id % 11 = 0) SELECT id FROM e WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g)",
    "imported_nodes": f"WITH {NODES_SQL} SELECT id FROM n WHERE id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM n o WHERE o.id % 2 = 0 AND o.qualified_name = n.qualified_name)",
    "renamed_symbols": rf"WITH {NODES_SQL}, {_TOP_NAME} SELECT id, 'renamed_one' AS name, array_to_string([CASE WHEN x = top.name THEN 'renamed_one' ELSE x END FOR x IN string_split(qualified_name, '.')], '.') AS qualified_name FROM n, top WHERE n.name = top.name",
    "node_ranks": rf"""WITH {NODES_SQL}, x AS (SELECT id, name, replace(coalesce(file_path, ''), '\', '/') AS p, coalesce(properties, '') LIKE '%placeholder%' AS held FROM n WHERE properties IS NULL OR properties IN ('{{}}', '{{"placeholder": true}}'))
        SELECT id, CASE WHEN NOT held AND p <> '' THEN 100 ELSE 0 END + CASE WHEN contains(p, '/src/') THEN 50 WHEN contains(p, '/experiments/') OR contains(p, '/scripts/') THEN -50 ELSE 0 END
          + CASE WHEN name = 'merge_rank' OR name LIKE '%.merge_rank' THEN 20 ELSE 0 END AS preference, CAST(CASE WHEN held THEN 0.5 WHEN contains(coalesce(name, ''), '.') THEN 0.8 ELSE 1 END AS DOUBLE) AS confidence FROM x""",
    "shared_symbols": f"WITH {NODES_SQL}, x AS (SELECT DISTINCT name AS symbol, string_split(file_path, '/')[1] AS p FROM n WHERE name <> '' AND file_path <> '') SELECT symbol, string_agg(p, ',' ORDER BY p) AS projects FROM x GROUP BY symbol HAVING count(*) > 1",
    "node_filter": f"WITH {NODES_SQL} SELECT id, name FROM n WHERE lower(label) = 'function' AND contains(lower(name), 'rank') ORDER BY name, id LIMIT 20 OFFSET 5",
    "symbol_context": f"""WITH {_G}, k AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type = 'CALLS' AND source_id <> target_id AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
        f AS (SELECT file_path, count(*) - 1 AS k FROM n WHERE file_path <> '' GROUP BY file_path), u AS (SELECT t AS id, count(*) AS k FROM k GROUP BY t), d AS (SELECT s AS id, count(*) AS k FROM k GROUP BY s)
        SELECT n.id, coalesce(u.k, 0) AS callers, coalesce(d.k, 0) AS callees, coalesce(f.k, 0) AS in_file FROM n LEFT JOIN u USING (id) LEFT JOIN d USING (id) LEFT JOIN f USING (file_path) WHERE lower(label) IN ('function', 'method')""",
    "call_chain": f"""WITH {_G}, k AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type = 'CALLS'), top AS (SELECT name FROM e JOIN n ON n.id = e.target_id WHERE type = 'CALLS' AND name <> '' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1),
        st AS (SELECT id AS start FROM n WHERE name = (SELECT name FROM top)), a AS (SELECT start, s AS node, 1 AS depth FROM st JOIN k ON k.t = start), b AS (SELECT start, k.s, 2 FROM a JOIN k ON k.t = a.node)
        SELECT start, node, min(depth) AS depth FROM (FROM a UNION ALL FROM b) WHERE node <> start AND node IN (SELECT id FROM n) GROUP BY ALL""",
    "cyclic_imports": f"""WITH RECURSIVE {_G}, p AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE type IN ('IMPORTS', 'CALLS', 'USAGE') AND source_id <> target_id),
        r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "related_tests": rf"""WITH {LISTED_SQL}, w AS (SELECT file_path, lower(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.[^.]*$', '')) AS stem FROM d),
        x AS (FROM w UNION SELECT 't/test_' || stem || '_more.py', 'test_' || stem || '_more' FROM w WHERE length(file_path) % 2 = 0), y AS (SELECT *, regexp_replace(stem, '^tests?_|[._-](tests?|spec)$', '', 'g') AS bare FROM x)
        SELECT DISTINCT s.file_path, t.file_path AS test FROM y t JOIN y s ON t.bare = s.stem OR starts_with(t.bare, s.stem || '_') WHERE t.bare <> t.stem AND s.bare = s.stem AND s.stem <> ''""",
    "code_topology": f"""WITH {_G}, o AS (SELECT source_id AS id, count(*) AS k FROM e WHERE type = 'CALLS' GROUP BY 1)
        SELECT file_path, count(*) AS functions, count(*) FILTER (id NOT IN (SELECT target_id FROM e WHERE type = 'CALLS')) AS without_callers, CAST(coalesce(sum(k), 0) AS BIGINT) AS calls_out
        FROM n LEFT JOIN o USING (id) WHERE lower(label) IN ('function', 'method') AND file_path <> '' GROUP BY file_path""",
    "trust_stamps": rf"""WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, lower(replace(file_path, '\', '/')) AS p FROM c WHERE regexp_matches(text, '\S') AND trim(file_path) <> '')
        SELECT chunk_id, CASE WHEN len(list_intersect(string_split(p, '/')[1:-2], ['vendor', 'node_modules', 'third_party', 'site-packages'])) > 0 THEN 'external' WHEN regexp_matches(p, '\.(md|rst|txt)$') THEN 'docs'
          WHEN regexp_matches(p, '\.[a-z0-9]+$') THEN 'code' ELSE 'unknown' END AS trust FROM x""",
    "name_suggestions": f"""WITH {NODES_SQL}, k AS (SELECT DISTINCT name FROM n WHERE length(name) >= 6), l AS (SELECT DISTINCT substring(name, 1, 2) || substring(name, 4) AS lost FROM n WHERE length(name) >= 6 AND id % 50 = 0),
        x AS (SELECT lost, name, CAST(levenshtein(lost, name) AS INTEGER) AS distance FROM l, k WHERE levenshtein(lost, name) <= least(3, length(lost) // 4)),
        r AS (SELECT *, row_number() OVER (PARTITION BY lost ORDER BY distance, name) AS r FROM x) SELECT lost, name, distance FROM r WHERE r <= 2""",
    "drifted_files": f"WITH {FILES_SQL}, {LISTED_SQL}, x AS (SELECT id, file_path, CASE WHEN length(file_path) % 3 = 0 THEN 'zz' || file_hash ELSE file_hash END AS file_hash FROM g) SELECT g.id AS doc, g.file_path AS symbol, left(g.file_hash, 8) AS noted, left(d.file_hash, 8) AS now FROM x g JOIN d ON g.file_path = d.file_path WHERE left(g.file_hash, 8) <> left(d.file_hash, 8)",
    "keyword_fallback": """WITH x AS (SELECT doc_id, list_sum([CAST(contains(lower(text), w) AS INTEGER) FOR w IN ['the', 'graph', 'loader', 'nightly', 'reindex']]) AS hits FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(hits AS INTEGER) AS hits FROM x WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20""",
    "relation_summary": f"""WITH {_G}, x AS (SELECT e.type AS kind, a.file_path AS fa, b.file_path AS fb, coalesce(weight, 1) AS w FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE a.file_path <> '' AND b.file_path <> ''),
        f AS (SELECT kind, count(DISTINCT f) AS files FROM (SELECT kind, fa AS f FROM x UNION ALL SELECT kind, fb FROM x) GROUP BY kind) SELECT kind, count(*) AS relations, any_value(files) AS files, round(sum(w), 6) AS weight FROM x JOIN f USING (kind) GROUP BY kind""",
    "subquery_coverage": f"WITH {CHUNKS_SQL}, {_HITS} SELECT file_path, count(DISTINCT query_id) AS queries FROM h GROUP BY file_path HAVING count(DISTINCT query_id) > 1",
    "subquery_relations": f"WITH {CHUNKS_SQL}, {_HITS}, o AS (SELECT DISTINCT * FROM h) SELECT a.query_id AS query_a, b.query_id AS query_b, count(*) AS shared FROM o a JOIN o b USING (file_path) WHERE a.query_id < b.query_id GROUP BY ALL",
    "enriched_results": f"""WITH {_G}, x AS (SELECT id, name, CASE WHEN lower(name) = 'rank' THEN 100 WHEN list_contains(string_split(lower(name), '_'), 'rank') THEN 85 WHEN starts_with(lower(name), 'rank') THEN 70 ELSE 10 END AS score FROM n WHERE contains(lower(name), 'rank')),
        t AS (SELECT id, name FROM x ORDER BY score DESC, name, id LIMIT 20), k AS (SELECT DISTINCT b.name AS s, a.name AS caller FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE type = 'CALLS' AND b.name IN (SELECT name FROM t)),
        r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY caller) AS r FROM k), g AS (SELECT s, string_agg(caller, ',' ORDER BY caller) AS callers FROM r WHERE r <= 3 GROUP BY s) SELECT t.id, callers FROM t LEFT JOIN g ON g.s = t.name""",
    "memory_states": f"WITH {_LOG} SELECT status, count(*) AS n FROM s GROUP BY status",
    "memory_visible": f"WITH {_LOG} SELECT id FROM s WHERE status = 'ACTIVE'",
    "false_retractions": f"""WITH {_LOG}, x AS (SELECT id, min(ts) FILTER (status = 'REFUTED') AS o, max(ts) FILTER (status = 'ACTIVE') AS b FROM l GROUP BY id)
        SELECT count(*) AS retracted, count(*) FILTER (b > o) AS restored, round(coalesce(count(*) FILTER (b > o) / nullif(count(*), 0), 0), 6) AS rate FROM x WHERE o IS NOT NULL""",
    "kept_verdicts": f"WITH {_LOG} SELECT id, CASE WHEN status = 'REFUTED' THEN status WHEN id % 3 = 0 THEN 'STALE' ELSE status END AS status FROM s",
    "context_budget": f"""WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY file_path ORDER BY chunk_index NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM c WHERE text IS NOT NULL AND file_path IS NOT NULL) SELECT * FROM x WHERE running <= 300""",
    "commit_search": f"WITH {COMMITS_SQL} SELECT hash, author FROM k WHERE message = 'fix crash' AND starts_with(hash, '1') AND hash IN (SELECT hash FROM kf WHERE file = 's7')",
    "embedding_canary": "SELECT count(*) AS rows, round(avg(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END), 4) AS mean_cosine, round(avg(CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END), 6) AS degraded FROM embeddings",
    "mention_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '@([\w.-]+)', 1)) AS INTEGER) AS mentions FROM documents WHERE text IS NOT NULL",
}
