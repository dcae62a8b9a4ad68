"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import graph as gr
from lodeworks.plans.cypher import cypher
from lodeworks.queries.base import EDGES_SQL, INSTANT, NODES_SQL, live_edges, live_nodes

PAGERANK_ROUNDS = 20

CYPHER = {
    "cypher_one_hop": "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN b.file_path AS file, count(*) AS calls, count(DISTINCT a.name) AS callers",
    "cypher_optional": "MATCH (a:Method) OPTIONAL MATCH (a)-[:USAGE]->(v:Variable) RETURN a.id AS method, v.qualified_name AS variable",
    "cypher_exists": "MATCH (a:Function) WHERE NOT EXISTS { (b)-[:CALLS]->(a) } AND EXISTS { (a)-[:CALLS]->(c) } RETURN a.id AS id, a.name AS name",
    "cypher_undirected": "MATCH (a:Class)-[:IMPORTS]-(b) WHERE b.label <> 'x' RETURN a.id AS class, count(*) AS links",
    "cypher_logic": "MATCH (f:Function) WHERE f.name STARTS WITH 'merge' OR (f.name CONTAINS 'rank' AND NOT (f.file_path CONTAINS '/tests/' OR f.file_path IS NULL)) RETURN f.id AS id",
    "cypher_two_hops": "MATCH (a:Class)-[:DEFINES_METHOD]->(m:Method)-[:CALLS]->(b:Function) RETURN a.id AS class, count(DISTINCT b.id) AS functions",
    "cypher_bounded_path": "MATCH (a:Class)-[:DEFINES_METHOD|DEFINES*1..2]->(b) RETURN a.id AS class, count(*) AS paths",
    "cypher_in": "MATCH (f) WHERE f.name IN ['merge_rank', 'filter', 'load_node'] AND (f:Function OR f:Method) RETURN f.id AS id, f.name AS name",
    "cypher_regex": "MATCH (f:Function) WHERE f.name =~ '.*[Rr]ank.*' RETURN f.id AS id",
    "cypher_incoming": "MATCH (b:Function)<-[:CALLS]-(a:Method) RETURN b.id AS id, count(*) AS calls",
    "cypher_two_patterns": "MATCH (a:Class)-[:DEFINES_METHOD]->(m:Method) MATCH (m)-[:USAGE]->(v) RETURN a.id AS class, count(DISTINCT v.id) AS used",
    "cypher_top": "MATCH (a)-[:CALLS]->(b:Function) RETURN b.id AS id, count(*) AS calls ORDER BY calls DESC, id ASC SKIP 5 LIMIT 10",
}


def _cypher(query: str):
    return lambda spark, sf: cypher(live_nodes(spark, sf), live_edges(spark, sf), query)


def _starts(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """The callees with the most callers."""
    calls = gr.of_type(live_edges(spark, sf), "CALLS")
    return calls.groupBy(F.col("target_id").alias("start")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "start").limit(n).select("start")


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return gr.graph_stats(live_nodes(spark, sf), live_edges(spark, sf))


def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gr.graph_summary(live_nodes(spark, sf), live_edges(spark, sf))


def dead_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return gr.dead_code(live_nodes(spark, sf), live_edges(spark, sf)).select("id", "name", "file_path")


def dead_code_report(spark: SparkSession, sf: str) -> DataFrame:
    return gr.sarif(gr.dead_code(live_nodes(spark, sf), live_edges(spark, sf)))


def _pairs(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return gr.links(gr.of_type(live_edges(spark, sf), kind)).select("src", "dst")


def chain_no_shortcut(spark: SparkSession, sf: str) -> DataFrame:
    chains = gr.chain_without_shortcut(_pairs(spark, sf, "DECORATES"))
    return chains.groupBy("b").agg(F.count("*").alias("chains"))


def import_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of imports a->b->c without a->c."""
    return gr.chain_without_shortcut(_pairs(spark, sf, "IMPORTS"))


def import_chain_no_shortcut(spark: SparkSession, sf: str) -> DataFrame:
    return import_chains(spark, sf).groupBy("b").agg(F.count("*").alias("chains"))


def mutual_edges(spark: SparkSession, sf: str) -> DataFrame:
    return gr.mutual(_pairs(spark, sf, "CALLS"))


def hub_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return gr.hubs(live_edges(spark, sf), 10)


def bfs_depth3(spark: SparkSession, sf: str) -> DataFrame:
    calls = gr.links(gr.of_type(live_edges(spark, sf), "CALLS"), "incoming")
    return gr.bfs(calls, _starts(spark, sf), 3).select("start", "node", "depth")


def shortest_path_len(spark: SparkSession, sf: str) -> DataFrame:
    return gr.path_lengths(live_edges(spark, sf), _starts(spark, sf), 4)


def impact_risk(spark: SparkSession, sf: str) -> DataFrame:
    return gr.impact(live_nodes(spark, sf), live_edges(spark, sf), _starts(spark, sf), 2)


def data_flow(spark: SparkSession, sf: str) -> DataFrame:
    e = live_edges(spark, sf)
    starts = gr.of_type(e, "ASSIGNED_FROM").groupBy(F.col("source_id").alias("start")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "start").limit(10).select("start")
    return gr.flow(e, starts, 3)


def pagerank_20(spark: SparkSession, sf: str) -> DataFrame:
    ranks = gr.pagerank(_pairs(spark, sf, "CALLS"), PAGERANK_ROUNDS)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def communities(spark: SparkSession, sf: str) -> DataFrame:
    e = gr.of_type(live_edges(spark, sf), "CALLS", "IMPORTS").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("weight"))
    members = gr.communities(e)
    return gr.community_summary(members, live_nodes(spark, sf))


def repo_map(spark: SparkSession, sf: str) -> DataFrame:
    return gr.repo_map(live_nodes(spark, sf))


def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    return gr.symbol_search(live_nodes(spark, sf), "merge_rank", 20).select("id", "name", "score")


def symbol_references(spark: SparkSession, sf: str) -> DataFrame:
    e = live_edges(spark, sf)
    top = _starts(spark, sf, 1)
    users = gr.of_type(e, "CALLS").join(top, F.col("target_id") == F.col("start"), "left_semi").join(live_nodes(spark, sf).select(F.col("id").alias("source_id"), "name", "file_path"), "source_id")
    return users.select("name", "file_path").distinct()


def changed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf)
    files = n.where("file_path rlike '/core/'").select("file_path").distinct()
    return gr.changed_symbols(n, live_edges(spark, sf), files)


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf).where("file_path is not null and file_path <> ''").select("id", F.element_at(F.split("file_path", "/"), 1).alias("p"))
    e = gr.of_type(live_edges(spark, sf), "CALLS")
    return e.join(n.select(F.col("id").alias("source_id"), F.col("p").alias("src")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("p").alias("dst")), "target_id").where("src <> dst")


def project_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return _projects(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("calls"), F.count_distinct("target_id").alias("symbols"))


def project_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of up to three projects over links of at least three calls."""
    strong = _projects(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n >= 3").select("src", "dst")
    return gr.cycles(strong, 3).select(F.array_join("path", ">").alias("cycle"))


def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    n = live_nodes(spark, sf)
    calls = n.where("name <> ''").select(F.col("id").alias("call_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("self."), "name")).when(F.col("id") % 7 == 0, F.concat("name", F.lit("_gone"))).otherwise(F.col("name")).alias("callee"))
    return gr.resolve_calls(calls, n).withColumn("target_id", F.coalesce("target_id", F.lit(-1)))


def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    n, e = live_nodes(spark, sf), gr.of_type(live_edges(spark, sf), "CALLS")
    real = e.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("subject")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("object")), "target_id").where("subject <> '' and object <> ''")
    claims = real.select(F.col("id").cast("string").alias("claim_id"), "subject", F.lit("calls").alias("predicate"), F.when(F.col("id") % 2 == 0, F.col("object")).otherwise(F.lit("zz_nothing")).alias("object"))
    return gr.verify_claims(claims, n, e)


def retract_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as memory nodes that depend on their parents; the parents with the smallest ids are retracted."""
    from lodeworks.common import counting_rows, micros_of, table

    rows = table(spark, sf, "index_guard")
    at = counting_rows(rows, "id", micros_of(rows, "indexed_at"), parent=F.col("parent_id")).where("parent is not null and parent <> ''")
    memory = at.select(F.col("id").alias("node_id"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.array("parent").alias("depends_on"))
    out = [r[0] for r in at.select("parent").distinct().orderBy("parent").limit(20).collect()]
    return gr.retract(memory, out)


QUERIES = {k: _cypher(q) for k, q in CYPHER.items()} | {
    f.__name__: f
    for f in (
        graph_stats, graph_summary, dead_nodes, dead_code_report, chain_no_shortcut, import_chains, import_chain_no_shortcut, mutual_edges, hub_nodes, bfs_depth3, shortest_path_len, impact_risk, data_flow, pagerank_20, communities,
        repo_map, symbol_search, symbol_references, changed_symbols, project_dependencies, project_cycles, call_resolution, claim_verdicts, retract_cascade,
    )
}

_G = f"{NODES_SQL}, {EDGES_SQL}"
_STARTS = "starts AS (SELECT target_id AS start FROM e WHERE type = 'CALLS' GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT {n})"


def _reach(step: str, depth: int) -> str:
    return f"""walk AS (SELECT start, start AS node, 0 AS depth FROM starts UNION SELECT w.start, s.dst, w.depth + 1 FROM walk w JOIN ({step}) s ON s.src = w.node WHERE w.depth < {depth}),
    reach AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"""


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH {EDGES_SQL}, l AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, count(*) AS w FROM e WHERE type = 'CALLS' GROUP BY ALL),
      o AS (SELECT src, sum(w) AS total FROM l GROUP BY src), sh AS MATERIALIZED (SELECT l.src, l.dst, l.w / o.total AS share FROM l JOIN o USING (src)),
      nd AS MATERIALIZED (SELECT src AS node FROM l UNION SELECT dst FROM l), cnt AS (SELECT count(*)::DOUBLE AS n FROM nd),
      r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nd, cnt)"""
    for i in range(1, rounds + 1):
        out += f""",
      r{i} AS MATERIALIZED (SELECT nd.node, 0.15::DOUBLE / cnt.n + 0.85::DOUBLE * coalesce(g.v, 0) AS rank FROM nd CROSS JOIN cnt LEFT JOIN (SELECT sh.dst, sum(r.rank * sh.share) AS v FROM sh JOIN r{i - 1} r ON r.node = sh.src GROUP BY sh.dst) g ON g.dst = nd.node)"""
    return out + f" SELECT node, round(rank / (SELECT max(rank) FROM r{rounds}), 6) AS rank FROM r{rounds}"


ORACLES = {
    "cypher_one_hop": f"""WITH {_G} SELECT b.file_path AS file, count(*) AS calls, count(DISTINCT a.name) AS callers FROM n a JOIN e ON e.source_id = a.id JOIN n b ON b.id = e.target_id
        WHERE e.type = 'CALLS' AND lower(a.label) = 'function' AND lower(b.label) = 'function' GROUP BY b.file_path""",
    "cypher_optional": f"""WITH {_G} SELECT a.id AS method, x.q AS variable FROM n a LEFT JOIN (SELECT e.source_id, v.qualified_name AS q FROM e JOIN n v ON v.id = e.target_id WHERE e.type = 'USAGE' AND lower(v.label) = 'variable') x ON x.source_id = a.id
        WHERE lower(a.label) = 'method'""",
    "cypher_exists": f"""WITH {_G} SELECT id, name FROM n a WHERE lower(label) = 'function'
        AND NOT EXISTS (SELECT 1 FROM e JOIN n b ON b.id = e.source_id WHERE e.type = 'CALLS' AND e.target_id = a.id) AND EXISTS (SELECT 1 FROM e JOIN n c ON c.id = e.target_id WHERE e.type = 'CALLS' AND e.source_id = a.id)""",
    "cypher_undirected": f"""WITH {_G}, u AS (SELECT source_id AS s, target_id AS t FROM e WHERE type = 'IMPORTS' UNION ALL SELECT target_id, source_id FROM e WHERE type = 'IMPORTS' AND source_id <> target_id)
        SELECT a.id AS class, count(*) AS links FROM n a JOIN u ON u.s = a.id JOIN n b ON b.id = u.t WHERE lower(a.label) = 'class' AND b.label <> 'x' GROUP BY a.id""",
    "cypher_logic": f"""WITH {_G} SELECT id FROM n WHERE lower(label) = 'function' AND (starts_with(name, 'merge') OR (contains(name, 'rank') AND NOT (contains(file_path, '/tests/') OR file_path IS NULL)))""",
    "cypher_two_hops": f"""WITH {_G} SELECT a.id AS class, count(DISTINCT b.id) AS functions FROM n a JOIN e e1 ON e1.source_id = a.id JOIN n m ON m.id = e1.target_id JOIN e e2 ON e2.source_id = m.id JOIN n b ON b.id = e2.target_id
        WHERE lower(a.label) = 'class' AND lower(m.label) = 'method' AND lower(b.label) = 'function' AND e1.type = 'DEFINES_METHOD' AND e2.type = 'CALLS' GROUP BY a.id""",
    "cypher_bounded_path": f"""WITH {_G}, d AS (SELECT id, source_id AS s, target_id AS t FROM e WHERE type IN ('DEFINES_METHOD', 'DEFINES')),
        p AS (SELECT s, t FROM d UNION ALL SELECT x.s, y.t FROM d x JOIN d y ON x.t = y.s AND x.id <> y.id)
        SELECT a.id AS class, count(*) AS paths FROM n a JOIN p ON p.s = a.id JOIN n b ON b.id = p.t WHERE lower(a.label) = 'class' GROUP BY a.id""",
    "cypher_in": f"""WITH {_G} SELECT id, name FROM n WHERE name IN ('merge_rank', 'filter', 'load_node') AND lower(label) IN ('function', 'method')""",
    "cypher_regex": f"""WITH {_G} SELECT id FROM n WHERE lower(label) = 'function' AND regexp_full_match(name, '.*[Rr]ank.*')""",
    "cypher_incoming": f"""WITH {_G} SELECT b.id AS id, count(*) AS calls FROM n a JOIN e ON e.source_id = a.id JOIN n b ON b.id = e.target_id WHERE e.type = 'CALLS' AND lower(a.label) = 'method' AND lower(b.label) = 'function' GROUP BY b.id""",
    "cypher_two_patterns": f"""WITH {_G} SELECT a.id AS class, count(DISTINCT v.id) AS used FROM n a JOIN e e1 ON e1.source_id = a.id JOIN n m ON m.id = e1.target_id JOIN e e2 ON e2.source_id = m.id JOIN n v ON v.id = e2.target_id
        WHERE lower(a.label) = 'class' AND lower(m.label) = 'method' AND e1.type = 'DEFINES_METHOD' AND e2.type = 'USAGE' GROUP BY a.id""",
    "cypher_top": f"""WITH {_G} SELECT b.id AS id, count(*) AS calls FROM n a JOIN e ON e.source_id = a.id JOIN n b ON b.id = e.target_id WHERE e.type = 'CALLS' AND lower(b.label) = 'function' GROUP BY b.id ORDER BY calls DESC, id LIMIT 10 OFFSET 5""",
    "graph_stats": f"WITH {_G} SELECT 'node' AS kind, lower(label) AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', lower(type), count(*) FROM e GROUP BY ALL",
    "graph_summary": f"WITH {_G} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT file_path) FROM n) AS files, (SELECT count(*) FROM e) AS edges",
    "dead_nodes": f"""WITH {_G} SELECT id, name, file_path FROM n WHERE lower(label) IN ('function', 'method') AND coalesce(name, '') NOT IN ('main', 'run', 'start', 'handle', 'entry', 'bootstrap', 'init_app')
        AND NOT EXISTS (SELECT 1 FROM e WHERE e.target_id = n.id AND e.type IN ('CALLS', 'ASYNC_CALLS'))""",
    "chain_no_shortcut": f"""WITH {_G}, p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type = 'DECORATES' AND source_id <> target_id)
        SELECT x.t AS b, count(*) AS chains FROM p x JOIN p y ON x.t = y.s WHERE x.s <> y.t AND NOT EXISTS (SELECT 1 FROM p z WHERE z.s = x.s AND z.t = y.t) GROUP BY x.t""",
    "mutual_edges": f"""WITH {_G}, p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type = 'CALLS') SELECT x.s AS a, x.t AS b FROM p x JOIN p y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t""",
    "hub_nodes": f"WITH {_G} SELECT target_id AS id, count(*) AS degree FROM e GROUP BY target_id HAVING count(*) > 10",
    "bfs_depth3": f"WITH RECURSIVE {EDGES_SQL}, {_STARTS.format(n=5)}, {_reach("SELECT target_id AS src, source_id AS dst FROM e WHERE type = 'CALLS'", 3)} SELECT start, node, depth FROM reach",
    "shortest_path_len": f"WITH RECURSIVE {EDGES_SQL}, {_STARTS.format(n=5)}, {_reach('SELECT source_id AS src, target_id AS dst FROM e', 4)} SELECT start, node, depth FROM reach",
    "pagerank_20": _pagerank_sql(PAGERANK_ROUNDS),
    "repo_map": f"WITH {NODES_SQL} SELECT file_path, count(*) AS symbols, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM n WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY file_path",
    "symbol_references": f"WITH {_G}, {_STARTS.format(n=1)} SELECT DISTINCT a.name, a.file_path FROM e JOIN starts ON start = e.target_id JOIN n a ON a.id = e.source_id WHERE e.type = 'CALLS'",
    "changed_symbols": f"""WITH {_G}, o AS (SELECT id, file_path FROM n WHERE regexp_matches(file_path, '/core/')),
        r AS (SELECT o.file_path, count(DISTINCT u.file_path) AS referring_files FROM o JOIN e ON e.target_id = o.id JOIN n u ON u.id = e.source_id WHERE u.file_path <> o.file_path GROUP BY ALL)
        SELECT o.file_path, count(*) AS defined, coalesce(max(r.referring_files), 0) AS referring_files FROM o LEFT JOIN r USING (file_path) GROUP BY o.file_path""",
    "project_dependencies": f"""WITH {_G}, p AS (SELECT id, string_split(file_path, '/')[1] AS p FROM n WHERE file_path IS NOT NULL AND file_path <> '')
        SELECT a.p AS src, b.p AS dst, count(*) AS calls, count(DISTINCT e.target_id) AS symbols FROM e JOIN p a ON a.id = e.source_id JOIN p b ON b.id = e.target_id WHERE e.type = 'CALLS' AND a.p <> b.p GROUP BY ALL""",
    "project_cycles": f"""WITH {_G}, p AS (SELECT id, string_split(file_path, '/')[1] AS p FROM n WHERE file_path IS NOT NULL AND file_path <> ''),
        l AS (SELECT a.p AS s, b.p AS t FROM e JOIN p a ON a.id = e.source_id JOIN p b ON b.id = e.target_id WHERE e.type = 'CALLS' AND a.p <> b.p GROUP BY ALL HAVING count(*) >= 3)
        SELECT x.s || '>' || x.t AS cycle FROM l x JOIN l y ON x.t = y.s AND y.t = x.s WHERE x.s < x.t
        UNION ALL SELECT x.s || '>' || x.t || '>' || y.t FROM l x JOIN l y ON x.t = y.s JOIN l z ON y.t = z.s AND z.t = x.s WHERE x.s < x.t AND x.s < y.t AND x.t <> y.t""",
    "retract_cascade": f"""WITH RECURSIVE m AS (SELECT id, r.p AS parent FROM (SELECT id, arg_max(struct_pack(p := parent_id), {INSTANT.format(c="indexed_at")}) AS r FROM index_guard GROUP BY id) WHERE r.p IS NOT NULL AND r.p <> ''),
        s AS (SELECT DISTINCT parent AS id FROM m ORDER BY parent LIMIT 20), w AS (SELECT id AS node, 0 AS depth FROM s UNION SELECT m.id, w.depth + 1 FROM w JOIN m ON m.parent = w.node WHERE w.depth < 60)
        SELECT node AS node_id, min(depth) AS depth FROM w WHERE node NOT IN (SELECT id FROM s) GROUP BY node""",
}

_WALK = """{a} AS (SELECT start, start AS node, 0 AS d FROM starts UNION SELECT w.start, e.{to}, w.d + 1 FROM {a} w JOIN e ON e.{of} = w.node WHERE e.type = '{kind}' AND w.d < {depth}),
  {a}r AS (SELECT start, node, min(d) AS depth FROM {a} GROUP BY ALL HAVING min(d) > 0)"""

_IMPORT_CHAINS = f"""{EDGES_SQL}, p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE type = 'IMPORTS' AND source_id <> target_id),
    chain AS (SELECT x.s AS a, x.t AS b, y.t AS c FROM p x JOIN p y ON x.t = y.s WHERE x.s <> y.t AND NOT EXISTS (SELECT 1 FROM p z WHERE z.s = x.s AND z.t = y.t))"""

ORACLES |= {
    "import_chains": f"WITH {_IMPORT_CHAINS} SELECT a, b, c FROM chain",
    "import_chain_no_shortcut": f"WITH {_IMPORT_CHAINS} SELECT b, count(*) AS chains FROM chain GROUP BY b",
    "data_flow": f"""WITH RECURSIVE {EDGES_SQL}, starts AS (SELECT source_id AS start FROM e WHERE type = 'ASSIGNED_FROM' GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 10),
        {_WALK.format(a="u", to="target_id", of="source_id", kind="ASSIGNED_FROM", depth=3)}, {_WALK.format(a="v", to="source_id", of="target_id", kind="ASSIGNED_FROM", depth=3)}
        SELECT start, node, depth, 'from' AS way FROM ur UNION ALL SELECT start, node, depth, 'to' FROM vr""",
    "impact_risk": f"""WITH RECURSIVE {_G}, {_STARTS.format(n=5)}, {_WALK.format(a="u", to="source_id", of="target_id", kind="CALLS", depth=2)}, {_WALK.format(a="v", to="target_id", of="source_id", kind="CALLS", depth=2)},
        f AS (SELECT ur.start, ur.depth, replace(coalesce(n.file_path, ''), chr(92), '/') AS file FROM ur LEFT JOIN n ON n.id = ur.node),
        m AS (SELECT *, list_filter(list_reverse(string_split(file, '/'))[2:], lambda p: p <> '' AND p <> 'src' AND NOT contains(p, '.') AND NOT contains(p, ':'))[1] AS module FROM f),
        a AS (SELECT start, count(*) FILTER (depth = 1) AS direct_callers, count(*) FILTER (depth > 1) AS transitive_callers, count(*) FILTER (depth = 2) AS may_break, count(*) FILTER (depth >= 3) AS review,
            count(DISTINCT file) FILTER (file <> '') AS files, count(DISTINCT module) FILTER (file <> '') AS modules FROM m GROUP BY start),
        b AS (SELECT start, count(*) FILTER (depth = 1) AS direct_callees, count(*) FILTER (depth > 1) AS transitive_callees FROM vr GROUP BY start),
        r AS (SELECT s.start, coalesce(direct_callers, 0) AS direct_callers, coalesce(transitive_callers, 0) AS transitive_callers, coalesce(may_break, 0) AS may_break, coalesce(review, 0) AS review, coalesce(files, 0) AS files,
            coalesce(modules, 0) AS modules, coalesce(direct_callees, 0) AS direct_callees, coalesce(transitive_callees, 0) AS transitive_callees FROM starts s LEFT JOIN a USING (start) LEFT JOIN b USING (start)),
        k AS (SELECT *, CAST(least(100, least(30, direct_callers * 5) + least(20, transitive_callers * 2) + least(25, files * 3) + least(15, modules * 5) + least(10, direct_callees * 2)) AS BIGINT) AS risk FROM r)
        SELECT *, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM k""",
    "symbol_search": f"""WITH {NODES_SQL}, s AS (SELECT id, name, lower(name) AS l, list_filter(string_split(lower(name), '_'), lambda x: x <> '') AS p FROM n WHERE contains(lower(name), 'merge_rank')),
        c AS (SELECT *, len(list_intersect(['merge', 'rank'], p)) AS k FROM s)
        SELECT id, name, CAST(CASE WHEN l = 'merge_rank' THEN 100 WHEN k = 2 THEN 85 WHEN starts_with(l, 'merge_rank') THEN 70 WHEN k > 0 THEN 50 ELSE 10 END AS INTEGER) AS score FROM c ORDER BY score DESC, name, id LIMIT 20""",
    "call_resolution": f"""WITH {NODES_SQL}, c AS (SELECT id AS call_id, CASE WHEN id % 3 = 0 THEN 'self.' || name WHEN id % 7 = 0 THEN name || '_gone' ELSE name END AS callee FROM n WHERE name <> ''),
        x AS (SELECT call_id, n.id AS target_id, row_number() OVER (PARTITION BY call_id ORDER BY n.id) AS r FROM c JOIN n ON n.name = callee),
        t AS (SELECT call_id, string_split(callee, '.')[-1] AS last FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = callee)), l AS (SELECT id, string_split(name, '.')[-1] AS last FROM n),
        y AS (SELECT call_id, l.id AS target_id, row_number() OVER (PARTITION BY call_id ORDER BY l.id) AS r FROM t JOIN l USING (last))
        SELECT call_id, target_id, 'exact' AS how FROM x WHERE r <= 5 UNION ALL SELECT call_id, target_id, 'suffix' FROM y WHERE r <= 5 UNION ALL SELECT call_id, -1, 'placeholder' FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.last = t.last)""",
    "claim_verdicts": f"""WITH {_G}, x AS (SELECT e.id, a.name AS subject, b.name AS object FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE e.type = 'CALLS'),
        c AS (SELECT CAST(id AS VARCHAR) AS claim_id, subject, CASE WHEN id % 2 = 0 THEN object ELSE 'zz_nothing' END AS object FROM x WHERE subject <> '' AND object <> ''),
        h AS (SELECT claim_id, bool_or(contains(lower(x.object), lower(c.object))) AS hit FROM c JOIN x ON lower(x.subject) = lower(c.subject) GROUP BY claim_id)
        SELECT claim_id, CASE WHEN hit THEN 'confirmed' ELSE 'contradicted' END AS verdict, CAST(CASE WHEN hit THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence FROM h""",
}
