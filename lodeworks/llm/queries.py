"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import counting_rows, cut, micros_of, table
from lodeworks.llm import encode, funcdocs, generated, langid, mix, neighbours, split


def counting_chunks(spark: SparkSession, sf: str, only_long: int | None = None) -> DataFrame:
    """Counting rows of fts5_index. With ``only_long`` shorter texts become null before the shuffle."""
    rows = table(spark, sf, "fts5_index")
    text = F.col("text") if only_long is None else F.when(F.length("text") > only_long, F.col("text"))
    names = ["file_path", "symbol_name", "symbol_kind", "docstring", "line_start"]
    if only_long is not None:
        names = ["line_start"]
    columns = {n: F.col(n) for n in names} | {"text": text}
    packed = counting_rows(rows, "chunk_id", micros_of(rows, "indexed_at"), r=F.struct(*[c.alias(n) for n, c in columns.items()]))
    return packed.select("chunk_id", *[F.col(f"r.{n}").alias(n) for n in columns])


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = counting_chunks(spark, sf, only_long=split.LIMIT)
    return split.split_oversized(chunks, "chunk_id", "text", "line_start").withColumnRenamed("key", "chunk_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that came out in pieces: each has exactly one piece 1."""
    return p1_pieces(spark, sf).where("chunk_index = 1").select("chunk_id")


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Code-description pairs with their exact lines."""
    chunks = counting_chunks(spark, sf)
    return funcdocs.code_pairs(chunks, "chunk_id", "file_path", "symbol_name", "symbol_kind", "docstring", "text").withColumnRenamed("key", "chunk_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pairs(spark, sf).select("chunk_id", "symbol_name").distinct()


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Files of index_guard that nobody wrote by hand. Features are taken before the counting rows are, so no text is shuffled."""
    rows = table(spark, sf, "index_guard")
    is_file = F.coalesce(F.lower(F.trim("hierarchy_level")) == "file", F.lit(False))
    key = F.struct("id", micros_of(rows, "indexed_at").alias("at"), is_file.alias("is_file"))
    slim = rows.select(key.alias("key"), "file_path", F.when(is_file, F.col("text_full")).alias("text_full"))
    seen = generated.describe(slim, "key", "file_path", "text_full")
    latest = counting_rows(seen.select(F.col("key.id").alias("id"), F.col("key.at").alias("at"), F.struct(*seen.columns).alias("r")), "id", F.col("at"), r=F.col("r"))
    return generated.not_written_by_hand(latest.select("r.*").where("key.is_file and file_path is not null"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("file_path").distinct()


def p5_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Score of the forest and reason of each file, and whether it bears a label."""
    return _judged(spark, sf).select("file_path", F.round("score", 3).alias("score"), "reason", F.col("made").alias("labelled"))


def guard_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "index_guard")
    return counting_rows(rows, "id", micros_of(rows, "indexed_at"), vector=F.col("vector"))


def p6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar others of every comparable vector, however far."""
    near = neighbours.nearest(guard_vectors(spark, sf), "id", "vector")
    return near.withColumn("cos", F.round("cos", 6))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(guard_vectors(spark, sf), "id", "vector", least=0.9))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf: str, balanced: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", mix.source_name("source").alias("source"), "text")
    targets = table(spark, sf, "mix_targets")
    return (*mix.mixture(cut(encode.count_tokens(docs, "text")), targets, balanced=balanced), targets)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.shares(*_mixture(spark, sf))


def p8_shares_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Shares that the balanced draw reaches, to compare with the Bernoulli draw of p8_shares."""
    return mix.shares(*_mixture(spark, sf, balanced=True))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return langid.languages(docs, "doc_id", "text", "lang", langid.fit(docs, "doc_id", "text", "lang"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, sf)).withColumnRenamed("key", "doc_id")


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    return langid.document_language(_languages(spark, sf)).withColumnRenamed("key", "doc_id")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of every document in order, as code point ranges."""
    at = _languages(spark, sf).select(F.col("key").alias("doc_id"), F.posexplode("segments").alias("segment", "s"))
    return at.select("doc_id", "segment", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p5_found": p5_found,
    "p5_reasons": p5_reasons,
    "p6_found": p6_found,
    "p6_nearest": p6_nearest,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_shares_balanced": p8_shares_balanced,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
}

_INSTANT = """epoch_us(CASE WHEN regexp_matches(trim({c}), '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND length(trim({c})) > 10
  THEN CAST(trim({c}) AS TIMESTAMPTZ) ELSE CAST(trim({c}) || 'Z' AS TIMESTAMPTZ) END)"""

ORACLES = {
    "p1_found": f"""SELECT chunk_id FROM (SELECT chunk_id, arg_max(struct_pack(t := text), {_INSTANT.format(c="indexed_at")}) AS r FROM fts5_index GROUP BY chunk_id)
        WHERE length(r.t) > 1800""",
}
