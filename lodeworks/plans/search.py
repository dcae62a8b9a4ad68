"""Hybrid retrieval as one plan over many queries: lexical, full-text and vector rankings, fused, boosted and diversified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut
from lodeworks.functions.text import expand_query, intent
from lodeworks.operators import fusion, lexical, vector
from lodeworks.operators.inverted import InvertedIndex, full_text_search


@dataclass(frozen=True)
class Modes:
    """What each mode does; fast is vectors alone."""

    use_text: bool = True
    diversify: bool = True
    rounds: int = 1


MODES = {"fast": Modes(use_text=False, diversify=False), "quality": Modes(), "deep": Modes(rounds=2)}


def over_fetch(limit: int, most: int = 30) -> int:
    """Candidates taken per source: twice the limit, ``most`` at the most, but never fewer than the limit."""
    return max(limit, min(max(limit * 2, 1), most))


def result_budget(files: int) -> int:
    """Results by the size of a project."""
    return 4 if files < 50 else 6 if files < 200 else 8 if files < 1000 else 10


def hybrid_search(
    index: InvertedIndex, queries: dict[str, str], query_vectors: DataFrame | None = None, mode: str = "quality", limit: int = 10, coupling: DataFrame | None = None,
    layer: str | None = None, since_us: int | None = None, trace: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, rank), and with ``trace`` the rank in every stage.

    index: of chunk_id with ``CHUNK_FIELDS``, and file_path, symbol_name, text, docstring, layer, vector, at_us stored.
    query_vectors: (query_id, query_vector). In order: vectors prefiltered by layer, words by their stored postings and then
    filtered by it, the rankings of up to three variants of each query, reciprocal ranks, weight by kind of file,
    co-change, cut, diversity, exact names first, one row per file and symbol, and last the bound in time. Texts are
    fetched for the fused rows only.
    """
    spark = index.spark
    m = MODES[mode]
    k = over_fetch(limit)

    def in_layer(hits: DataFrame) -> DataFrame:
        if layer is None:
            return hits
        return hits.join(index.fetch(hits, ["layer"]).where(F.col("layer") == layer).select("chunk_id"), "chunk_id", "left_semi")

    lists = {}
    if query_vectors is not None:
        base = index.docs().select("chunk_id", "layer", "vector")
        near = vector.knn(base if layer is None else base.where(F.col("layer") == layer), "chunk_id", "vector", query_vectors, k)
        lists["vector"] = near.select("query_id", "chunk_id", "rank")
    if m.use_text:
        variants = {f"{q}\x1f{i}": v for q, text in queries.items() for i, v in enumerate(expand_query(text))}
        hits = in_layer(index.lexical(lexical.query_terms(spark, variants), "text", k))
        own = hits.withColumn("query_id", F.element_at(F.split("query_id", "\x1f"), 1))
        best = own.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
        lists["lexical"] = fusion.ranked(best, "query_id", "chunk_id")
        lists["full_text"] = in_layer(full_text_search(index, queries, k)).select("query_id", "chunk_id", "rank")
    if not lists:
        raise ValueError("fast mode needs query vectors")
    fused = cut(fusion.fused(list(lists.values()), "query_id", "chunk_id", 3 * k))
    q = spark.createDataFrame(list(queries.items()), "query_id string, query string").withColumn("intent", intent("query"))
    stored = index.fetch(fused, ["file_path", "symbol_name", "text", "vector", "at_us"])
    at = fused.select("query_id", "chunk_id", "score").join(stored, "chunk_id").join(q, "query_id")
    at = at.withColumn("score", F.round(F.col("score") * fusion.bucket_weight("file_path", F.col("intent")), 9))
    if coupling is not None:
        at = fusion.cochange_boost(at, coupling, "query_id", "chunk_id")
    top = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    at = cut(at.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r"))
    if m.diversify and query_vectors is not None:
        spread = fusion.mmr(at.where("vector is not null"), "query_id", "chunk_id", limit).select("query_id", "chunk_id", F.col("rank").alias("mmr"))
        at = at.join(spread, ["query_id", "chunk_id"], "left")
    else:
        at = at.withColumn("mmr", F.lit(None).cast("int"))
    exact = fusion.exact_name(F.col("query"), F.col("symbol_name"), F.col("text"))
    at = fusion.exact_boost(at, "query_id", "chunk_id", exact, "file_path")
    at = at.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("boosted"), F.col("mmr").asc_nulls_last(), "rank")))
    one = W.partitionBy("query_id", "file_path", F.coalesce("symbol_name", "chunk_id")).orderBy("place")
    at = at.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    final = at.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= limit)
    if since_us is not None:
        final = final.where(F.col("at_us") >= since_us)
    out = final.select("query_id", "chunk_id", "score", "rank", "boosted", "mmr") if trace else final.select("query_id", "chunk_id", "score", "rank")
    if trace:
        for name, ranking in lists.items():
            out = out.join(ranking.select("query_id", "chunk_id", F.col("rank").alias(f"{name}_rank")), ["query_id", "chunk_id"], "left")
    return out


def deep_search(index: InvertedIndex, query: str, limit: int = 10, rounds: int = 3, terms: int = 3) -> DataFrame:
    """Searches again with terms that the best five results share, until a round brings nothing new.

    index: of chunk_id with a field ``text`` of words, and text stored. Returns (chunk_id, rank) fused over the rounds. What comes to the driver is a handful of terms a round.
    """
    from lodeworks.functions.text import key_terms

    spark = index.spark
    seen: dict[str, str] = {}
    asked, text = 0, query
    lists = []
    while asked < rounds:
        asked += 1
        hits = cut(index.lexical(lexical.query_terms(spark, {"q": text}), "text", over_fetch(limit)))
        lists.append(hits.select("query_id", "chunk_id", "rank"))
        words = index.fetch(hits.where("rank <= 5"), ["text"]).select(F.explode(key_terms("text")).alias("w"))
        top = words.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "w").limit(terms).collect()
        new = [r["w"] for r in top if r["w"] not in seen and r["w"] not in query.lower()]
        if not new:
            break
        seen.update(dict.fromkeys(new, text))
        text = f"{query} {' '.join(new)}"
    return fusion.fused(lists, "query_id", "chunk_id", limit).select("chunk_id", "rank")


def multi_search(chunks: DataFrame, query_vectors: DataFrame, project: str, limit: int = 10) -> DataFrame:
    """Nearest rows of every project, fused by their rank in it."""
    near = vector.knn(chunks, "chunk_id", "vector", query_vectors, limit, group=project)
    total = near.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))), 9).alias("score"))
    return total.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= limit)


def decomposed_search(index: InvertedIndex, query: str, limit: int = 10) -> DataFrame:
    """Sub-queries in one job, their lists fused; (chunk_id, score, rank)."""
    from lodeworks.functions.text import decompose

    parts = {str(i): p for i, p in enumerate(decompose(query))}
    hits = index.lexical(lexical.query_terms(index.spark, parts), "text", over_fetch(limit))
    return fusion.fused([hits.select(F.lit("all").alias("g"), "chunk_id", "rank")], "g", "chunk_id", limit).drop("g")


def enriched(results: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 10, callers: int = 3) -> DataFrame:
    """The first results with up to three callers of their symbol."""
    named = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("symbol_name"))
    calls = edges.where(F.upper("type") == "CALLS").join(named, "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("caller")), "source_id")
    few = calls.select("symbol_name", "caller").distinct().withColumn("r", F.row_number().over(W.partitionBy("symbol_name").orderBy("caller"))).where(F.col("r") <= callers)
    listed = few.groupBy("symbol_name").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers"))
    return results.join(listed, "symbol_name", "left").withColumn("callers", F.when(F.col("rank") <= top, F.col("callers")))
