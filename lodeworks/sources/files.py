"""Source trees, logs and JSON stores as DataFrames, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.indexing import content_hash, decoded, has_code, ignored, looks_binary, safe_to_index
from lodeworks.operators.telemetry import parse_log


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(file_path, text, file_hash) of the files under ``root`` that are worth indexing.

    Paths are relative to root. Names and sizes are tested before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), F.lit("^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base) + "/"), F.lit(""))
    files = files.withColumn("file_path", rel).where(safe_to_index("file_path", "length") & ~ignored("file_path", ignore or []))
    texts = files.where(~looks_binary("content")).select("file_path", decoded("content").alias("text"))
    return texts.where(has_code("text")).withColumn("file_hash", content_hash("text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of log files."""
    return parse_log(spark.read.text(path))


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one array or one object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only file of JSON lines."""
    return spark.read.schema(schema).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def ledger_tail(rows: DataFrame, ts: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(ts)).limit(n)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables compressed with zstd."""
    nodes.write.option("compression", "zstd").parquet(f"{path}/nodes")
    edges.write.option("compression", "zstd").parquet(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def branch_table(spark: SparkSession, path: str, branch: str) -> DataFrame:
    """One branch of an index that is partitioned by it: other branches are not read."""
    return spark.read.parquet(path).where(F.col("branch") == branch)
