"""Views of the test tables that the queries share, and the same views as SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import counting_rows, micros_of, path_exists, remove_path, session_dir, table
from lodeworks.operators.inverted import CHUNK_FIELDS, Field, InvertedIndex

NODE_COLUMNS = ["name", "label", "qualified_name", "file_path", "properties"]


def live_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Counting rows of graph_nodes that were not removed."""
    rows = table(spark, sf, "graph_nodes")
    packed = counting_rows(rows, "id", micros_of(rows, "loaded_at"), r=F.struct(*NODE_COLUMNS, "removed_at"))
    return packed.where("r.removed_at is null").select("id", *[F.col(f"r.{c}").alias(c) for c in NODE_COLUMNS])


def live_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Counting rows of graph_edges with both ends."""
    rows = table(spark, sf, "graph_edges")
    columns = ["source_id", "target_id", "type", "weight", "properties"]
    packed = counting_rows(rows, "id", micros_of(rows, "loaded_at"), r=F.struct(*columns))
    at = packed.select("id", *[F.col(f"r.{c}").alias(c) for c in columns]).withColumn("type", F.upper(F.trim("type")))
    return at.where("source_id is not null and target_id is not null")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Counting rows of fts5_index."""
    rows = table(spark, sf, "fts5_index")
    columns = ["file_path", "chunk_index", "text", "symbol_name", "symbol_kind", "docstring", "layer"]
    packed = counting_rows(rows, "chunk_id", micros_of(rows, "indexed_at"), r=F.struct(*columns))
    return packed.select("chunk_id", *[F.col(f"r.{c}").alias(c) for c in columns], F.col("_at").alias("at_us"))


def _stored(spark: SparkSession, sf: str, name: str, build) -> InvertedIndex:
    """The index of this name over these tables; the first query that needs it in a session builds it, the others read it."""
    path = f"{session_dir(spark)}/index-{name}-{zlib.crc32(sf.encode()):08x}"
    if path_exists(spark, f"{path}/stats/segment=0/_SUCCESS"):
        return InvertedIndex.open(spark, path)
    remove_path(spark, path)
    return build(path)


def document_index(spark: SparkSession, sf: str) -> InvertedIndex:
    """Stored index over the texts of ``documents``."""
    return _stored(spark, sf, "documents", lambda path: InvertedIndex.build(
        table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), path, "chunk_id", {"text": Field("words", ("text",))}, ["text"]))


def chunk_index(spark: SparkSession, sf: str) -> InvertedIndex:
    """Stored index over the counting rows of fts5_index that have a text, with the smallest id's vector of their file."""

    def build(path: str) -> InvertedIndex:
        guard = table(spark, sf, "index_guard").where("size(vector) = 64").groupBy("file_path").agg(F.min_by("vector", "id").alias("vector"))
        rows = chunks(spark, sf).join(guard, "file_path", "left").where("text is not null")
        return InvertedIndex.build(rows, path, "chunk_id", CHUNK_FIELDS, ["file_path", "symbol_name", "text", "docstring", "layer", "vector", "at_us"])

    return _stored(spark, sf, "chunks", build)


def guard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Counting file rows of index_guard: file_path, file_hash, text_full."""
    rows = table(spark, sf, "index_guard")
    packed = counting_rows(rows, "id", micros_of(rows, "indexed_at"), r=F.struct("file_path", "file_hash", "text_full", "hierarchy_level"))
    return packed.where("r.hierarchy_level = 'file'").select("id", F.col("r.file_path").alias("file_path"), F.col("r.file_hash").alias("file_hash"), F.col("r.text_full").alias("text"), F.col("_at").alias("at_us"))


def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files on disk: counting rows of file_listing that were not deleted."""
    rows = table(spark, sf, "file_listing")
    packed = counting_rows(rows, "file_path", micros_of(rows, "scanned_at"), r=F.struct("file_hash", "project", "language", "deleted_at"))
    return packed.where("r.deleted_at is null").select("file_path", F.col("r.file_hash").alias("file_hash"), F.col("r.project").alias("project"), F.col("r.language").alias("language"))


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits: the suppliers of their lines are the files, the priority is the message."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("files"))
    orders = table(spark, sf, "orders")
    at = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    message = F.when(F.col("o_orderpriority") == "1-URGENT", "fix crash").when(F.col("o_orderpriority") == "2-HIGH", "refactor api").otherwise("add feature")
    return at.select(
        F.col("o_orderkey").cast("string").alias("hash"), F.col("o_custkey").cast("string").alias("author"), F.lit(None).cast("string").alias("email"), F.col("o_orderdate").alias("date"),
        message.alias("message"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("").alias("body"), F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )


INSTANT = """epoch_us(CASE WHEN regexp_matches(trim({c}), '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND length(trim({c})) > 10
  THEN CAST(trim({c}) AS TIMESTAMPTZ) ELSE CAST(trim({c}) || 'Z' AS TIMESTAMPTZ) END)"""

NODES_SQL = """n AS (SELECT id, r.name AS name, r.label AS label, r.qualified_name AS qualified_name, r.file_path AS file_path, r.properties AS properties FROM (
    SELECT id, arg_max(struct_pack(name := name, label := label, qualified_name := qualified_name, file_path := file_path, properties := properties, gone := removed_at), loaded_at) AS r
    FROM graph_nodes WHERE id IS NOT NULL GROUP BY id) WHERE r.gone IS NULL)"""
EDGES_SQL = """e AS (SELECT id, r.s AS source_id, r.t AS target_id, upper(trim(r.k)) AS type, r.w AS weight FROM (
    SELECT id, arg_max(struct_pack(s := source_id, t := target_id, k := type, w := weight), loaded_at) AS r FROM graph_edges WHERE id IS NOT NULL GROUP BY id)
    WHERE r.s IS NOT NULL AND r.t IS NOT NULL)"""
CHUNKS_SQL = f"""c AS (SELECT chunk_id, r.file_path AS file_path, r.chunk_index AS chunk_index, r.text AS text, r.symbol_name AS symbol_name, r.symbol_kind AS symbol_kind, r.docstring AS docstring, r.layer AS layer, at_us FROM (
    SELECT chunk_id, arg_max(struct_pack(file_path := file_path, chunk_index := chunk_index, text := text, symbol_name := symbol_name, symbol_kind := symbol_kind, docstring := docstring, layer := layer), {INSTANT.format(c="indexed_at")}) AS r,
      max({INSTANT.format(c="indexed_at")}) AS at_us FROM fts5_index GROUP BY chunk_id))"""
FILES_SQL = f"""g AS (SELECT id, r.p AS file_path, r.h AS file_hash, r.t AS text, at_us FROM (
    SELECT id, arg_max(struct_pack(p := file_path, h := file_hash, t := text_full, l := hierarchy_level), {INSTANT.format(c="indexed_at")}) AS r, max({INSTANT.format(c="indexed_at")}) AS at_us FROM index_guard GROUP BY id) WHERE r.l = 'file')"""
LISTED_SQL = """d AS (SELECT file_path, r.h AS file_hash, r.p AS project, r.l AS language FROM (
    SELECT file_path, arg_max(struct_pack(h := file_hash, p := project, l := language, x := deleted_at), scanned_at) AS r FROM file_listing GROUP BY file_path) WHERE r.x IS NULL)"""
COMMITS_SQL = """k AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, CAST(o_custkey AS VARCHAR) AS author, o_orderdate AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'fix crash' WHEN '2-HIGH' THEN 'refactor api' ELSE 'add feature' END AS message,
    CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS body FROM orders),
  kf AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash, 's' || CAST(l_suppkey AS VARCHAR) AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
TOKENS = r"string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_]+')"
