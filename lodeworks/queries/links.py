"""Queries of problems 3 and 4: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import counting_rows, micros_of, table, union_all
from lodeworks.operators.hierarchy import descendant_pairs, hierarchy, other_parent_links, parent_links
from lodeworks.operators.references import Children, orphan_report, orphans

#: The types of containment edges, parent to child.
CONTAINMENT = ["contains_folder", "contains_package", "contains_file", "defines", "defines_method"]


def containment_links(spark: SparkSession, sf: str) -> DataFrame:
    """(tree, node, parent) of both tables; only counting rows link."""
    edges = table(spark, sf, "graph_edges")
    edge = counting_rows(
        edges, "id", micros_of(edges, "loaded_at"), source=F.col("source_id"), target=F.col("target_id"), holds=F.lower(F.trim("type")).isin(CONTAINMENT)
    )
    chunks = table(spark, sf, "index_guard")
    chunk = counting_rows(chunks, "id", micros_of(chunks, "indexed_at"), parent=F.col("parent_id"))
    return union_all([
        edge.where("holds").select(F.lit("graph_edges").alias("tree"), F.col("target").cast("string").alias("node"), F.col("source").cast("string").alias("parent")),
        chunk.where("parent is not null and parent <> ''").select(F.lit("index_guard").alias("tree"), F.col("id").alias("node"), "parent"),
    ])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(containment_links(spark, sf), with_path=False, with_descendants=False)
    return tree.select(F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path and number of descendants of each node that hangs below a root; :func:`p3_nodes` has all nodes."""
    tree = hierarchy(containment_links(spark, sf)).where("depth > 0")
    return tree.select(F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.array_join("path", "/").alias("path"), "depth", "descendants")


def p3_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the links, roots and nodes of endless chains too; these have depth -1, no path and no descendants."""
    tree = hierarchy(containment_links(spark, sf), with_roots=True)
    return tree.select(
        F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), "descendants", "cycle_edge",
    )


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every node in a tree, roots included."""
    pairs = descendant_pairs(hierarchy(containment_links(spark, sf)))
    return pairs.select(F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p3_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The parent link that closes each cycle."""
    links = containment_links(spark, sf)
    closing = hierarchy(links, with_path=False, with_descendants=False).where("cycle_edge").select("tree", "node")
    return parent_links(links).join(closing, ["tree", "node"]).select(F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"))


def p3_other_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parent links beside those the trees follow, of nodes with several parents."""
    return other_parent_links(containment_links(spark, sf)).select(F.col("tree").alias("table_name"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"))


def reference_parts(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], list[Children]]:
    nodes, files = table(spark, sf, "graph_nodes"), table(spark, sf, "file_listing")
    edges, rows = table(spark, sf, "graph_edges"), table(spark, sf, "fts5_index")
    node = counting_rows(nodes, "id", micros_of(nodes, "loaded_at"), since=micros_of(nodes, "created_at"), gone=F.col("removed_at").isNotNull())
    file = counting_rows(files, "file_path", micros_of(files, "scanned_at"), since=micros_of(files, "first_seen"), gone=F.col("deleted_at").isNotNull())
    edge = counting_rows(edges, "id", micros_of(edges, "loaded_at"), source=F.col("source_id"), target=F.col("target_id"))
    clean = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    row = counting_rows(rows, "chunk_id", micros_of(rows, "indexed_at"), ref=clean)
    parents = {
        "graph_nodes": node.select(F.col("id").cast("string").alias("ref"), "since", "gone"),
        "file_listing": file.select(F.col("file_path").alias("ref"), "since", "gone"),
    }
    edge = edge.select(F.col("id").cast("string").alias("record_id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("_at").alias("at"))
    children = [
        Children("graph_edges", "source_id", "graph_nodes", edge.select("record_id", F.col("source").alias("ref"), "at")),
        Children("graph_edges", "target_id", "graph_nodes", edge.select("record_id", F.col("target").alias("ref"), "at")),
        Children("fts5_index", "file_path", "file_listing", row.select(F.col("chunk_id").alias("record_id"), "ref", F.col("_at").alias("at"))),
    ]
    return parents, children


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodeworks.common import utc_month

    found = orphans(*reference_parts(spark, sf))
    return found.select("table_name", "field", "record_id", utc_month(F.col("at")).alias("period"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(orphans(*reference_parts(spark, sf)))


_INSTANT = """epoch_us(CASE WHEN regexp_matches(trim({c}), '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND length(trim({c})) > 10
  THEN CAST(trim({c}) AS TIMESTAMPTZ) ELSE CAST(trim({c}) || 'Z' AS TIMESTAMPTZ) END)"""

_LINKS = f"""
  edge AS (SELECT id, arg_max(struct_pack(s := source_id, t := target_id, k := lower(trim(type))), loaded_at) AS r FROM graph_edges GROUP BY id),
  chunk AS (SELECT id, arg_max(struct_pack(p := parent_id), {_INSTANT.format(c="indexed_at")}) AS r FROM index_guard GROUP BY id),
  link AS (
    SELECT 'graph_edges' AS tree, CAST(r.t AS VARCHAR) AS node, min(CAST(r.s AS VARCHAR)) AS parent FROM edge
    WHERE r.k IN ('contains_folder', 'contains_package', 'contains_file', 'defines', 'defines_method') AND r.s IS NOT NULL AND r.t IS NOT NULL
    GROUP BY ALL
    UNION ALL
    SELECT 'index_guard', id, r.p FROM chunk WHERE r.p IS NOT NULL AND r.p <> ''),
  up AS (
    SELECT tree, node, parent AS anc FROM link
    UNION
    SELECT up.tree, up.node, link.parent FROM up JOIN link ON link.tree = up.tree AND link.node = up.anc),
  reached AS (
    SELECT up.tree, up.node, max(CASE WHEN l.node IS NULL THEN up.anc END) AS root, CAST(count(*) AS INTEGER) AS depth
    FROM up LEFT JOIN link l ON l.tree = up.tree AND l.node = up.anc GROUP BY ALL)"""

_P4 = f"""
  edge AS (SELECT id, arg_max(struct_pack(s := source_id, t := target_id), loaded_at) AS r, max(loaded_at) AS tm FROM graph_edges GROUP BY id),
  node AS (SELECT id, arg_max(struct_pack(c := created_at, d := removed_at), loaded_at) AS r FROM graph_nodes GROUP BY id),
  file AS (SELECT file_path, arg_max(struct_pack(c := first_seen, d := deleted_at), scanned_at) AS r FROM file_listing GROUP BY file_path),
  row_ AS (SELECT chunk_id, arg_max(struct_pack(p := regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '')), {_INSTANT.format(c="indexed_at")}) AS r,
           max({_INSTANT.format(c="indexed_at")}) AS tm FROM fts5_index GROUP BY chunk_id),
  kid AS (
    SELECT 'graph_edges' AS table_name, 'source_id' AS field, CAST(id AS VARCHAR) AS record_id, 'n' || r.s AS ref, epoch_us(tm) AS tm FROM edge
    UNION ALL SELECT 'graph_edges', 'target_id', CAST(id AS VARCHAR), 'n' || r.t, epoch_us(tm) FROM edge
    UNION ALL SELECT 'fts5_index', 'file_path', chunk_id, 'f' || r.p, tm FROM row_),
  target AS (
    SELECT 'n' || id AS ref, epoch_us(r.c) AS since, r.d IS NOT NULL AS gone FROM node
    UNION ALL SELECT 'f' || file_path, epoch_us(r.c), r.d IS NOT NULL FROM file),
  orphan AS (
    SELECT table_name, field, record_id, strftime(make_timestamp(tm), '%Y-%m') AS period,
      CASE WHEN target.ref IS NULL THEN 'missing' WHEN gone THEN 'removed' ELSE 'later' END AS reason
    FROM kid LEFT JOIN target ON target.ref = kid.ref
    WHERE kid.ref IS NOT NULL AND (target.ref IS NULL OR gone OR since > tm))"""

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_nodes": p3_nodes, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles, "p3_other_parents": p3_other_parents, "p4_found": p4_found, "p4_report": p4_report}

ORACLES = {
    "p3_found": f"""WITH RECURSIVE {_LINKS}
        SELECT tree AS table_name, node AS node_id, coalesce(root, '') AS root_id, CASE WHEN root IS NULL THEN -1 ELSE depth END AS depth FROM reached""",
    "p3_paths": f"""WITH RECURSIVE {_LINKS},
        deep AS (SELECT up.tree, up.node, up.anc, coalesce(a.depth, 0) AS d FROM up LEFT JOIN reached a ON a.tree = up.tree AND a.node = up.anc),
        kids AS (SELECT tree, anc, count(*) AS n FROM up GROUP BY ALL)
        SELECT r.tree AS table_name, r.node AS node_id,
          (SELECT string_agg(deep.anc, '/' ORDER BY deep.d) FROM deep WHERE deep.tree = r.tree AND deep.node = r.node) || '/' || r.node AS path,
          r.depth, CAST(coalesce(k.n, 0) AS BIGINT) AS descendants
        FROM reached r LEFT JOIN kids k ON k.tree = r.tree AND k.anc = r.node WHERE r.root IS NOT NULL""",
    "p3_nodes": f"""WITH RECURSIVE {_LINKS},
        top AS (SELECT DISTINCT tree, root AS node FROM reached WHERE root IS NOT NULL),
        spot AS (SELECT tree, node, root, depth FROM reached UNION ALL SELECT tree, node, node, 0 FROM top),
        kids AS (SELECT tree, anc, count(*) AS n FROM up GROUP BY ALL),
        way AS (SELECT up.tree, up.node, string_agg(up.anc, '/' ORDER BY coalesce(a.depth, 0)) AS way FROM up LEFT JOIN reached a ON a.tree = up.tree AND a.node = up.anc GROUP BY ALL),
        ring AS (SELECT tree, node, min(anc) AS low FROM up WHERE (tree, anc, node) IN (SELECT tree, node, anc FROM up) GROUP BY ALL)
        SELECT s.tree AS table_name, s.node AS node_id, coalesce(s.root, '') AS root_id, CASE WHEN s.root IS NULL THEN -1 ELSE s.depth END AS depth,
          CASE WHEN s.root IS NOT NULL THEN coalesce(w.way || '/', '') || s.node END AS path, CASE WHEN s.root IS NOT NULL THEN CAST(coalesce(k.n, 0) AS BIGINT) END AS descendants,
          coalesce(ring.low = s.node, false) AS cycle_edge
        FROM spot s LEFT JOIN kids k ON k.tree = s.tree AND k.anc = s.node LEFT JOIN way w ON w.tree = s.tree AND w.node = s.node LEFT JOIN ring ON ring.tree = s.tree AND ring.node = s.node""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS}
        SELECT up.tree AS table_name, up.anc AS node_id, up.node AS descendant_id, CAST(r.depth - coalesce(a.depth, 0) AS INTEGER) AS distance
        FROM up JOIN reached r ON r.tree = up.tree AND r.node = up.node LEFT JOIN reached a ON a.tree = up.tree AND a.node = up.anc WHERE r.root IS NOT NULL""",
    "p3_cycles": f"""WITH RECURSIVE {_LINKS},
        ring AS (SELECT tree, node, min(anc) AS low FROM up WHERE (tree, anc, node) IN (SELECT tree, node, anc FROM up) GROUP BY ALL)
        SELECT link.tree AS table_name, link.node AS node_id, link.parent AS parent_id FROM ring JOIN link ON link.tree = ring.tree AND link.node = ring.node WHERE ring.low = ring.node""",
    "p3_other_parents": f"""WITH RECURSIVE {_LINKS},
        whole AS (SELECT DISTINCT CAST(r.t AS VARCHAR) AS node, CAST(r.s AS VARCHAR) AS parent FROM edge
          WHERE r.k IN ('contains_folder', 'contains_package', 'contains_file', 'defines', 'defines_method') AND r.s IS NOT NULL AND r.t IS NOT NULL)
        SELECT 'graph_edges' AS table_name, w.node AS node_id, w.parent AS parent_id FROM whole w JOIN link l ON l.tree = 'graph_edges' AND l.node = w.node WHERE w.parent <> l.parent""",
    "p4_found": f"WITH {_P4} SELECT table_name, field, record_id, period FROM orphan",
    "p4_report": f"WITH {_P4} SELECT table_name, field, period, reason, count(*) AS orphans FROM orphan GROUP BY ALL",
}
