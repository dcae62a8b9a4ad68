"""Vector expressions and exact nearest neighbours of query vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut, drop_cut, session_dir

#: Query vectors that are broadcast at once.
MAX_QUERIES = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for null or zero vectors and unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def fitted(vector: str, dim: int) -> Column:
    """A vector cut or filled with zeros to ``dim`` entries."""
    v = F.col(vector)
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def not_zero(vector: str, least: float = 1e-9) -> Column:
    """Whether the squared length is at least ``least``."""
    return F.aggregate(F.col(vector), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) >= least


def _in_blocks(queries: DataFrame, near: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """near(queries); more than ``most`` queries are taken in blocks by the hash of their id, one after the other,
    so one block at a time is broadcast. Their results go to one table in the shared folder."""
    if queries.limit(most + 1).count() <= most:
        return near(queries)
    spark = queries.sparkSession
    all_ = cut(queries)
    parts = -(-2 * all_.count() // most)
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    for i in range(parts):
        found = near(all_.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))
        found.write.mode("append").parquet(path)
    drop_cut(all_)
    return spark.read.schema(found.schema).parquet(path)


def _against(rows: DataFrame, vector: str, queries: DataFrame) -> DataFrame:
    """Rows with each query and the cosine ``distance``, null where there is none; lengths are computed once per vector."""
    left = rows.where(F.col(vector).isNotNull()).withColumn("_norm", norm(F.col(vector)))
    both = left.crossJoin(F.broadcast(queries.withColumn("_query_norm", norm(F.col("query_vector")))))
    same = F.when(F.size(vector) == F.size("query_vector"), F.try_divide(dot(F.col(vector), F.col("query_vector")), F.col("_norm") * F.col("_query_norm")))
    return both.withColumn("distance", F.round(1 - same, 6)).drop("_norm", "_query_norm")


def knn(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, group: str | None = None, block: int = MAX_QUERIES) -> DataFrame:
    """(query_id, [group,] key, distance, rank): exact ``k`` nearest by cosine distance (L5), per group if given.

    queries: (query_id, query_vector). At most ``block`` of them are broadcast at once: the table is scanned once for
    each block and nothing but the best rows of each partition is shuffled.
    """
    keep = [group] if group else []
    order = W.partitionBy("query_id", *keep).orderBy(F.col("distance").asc_nulls_last(), key)

    def near(asked: DataFrame) -> DataFrame:
        at = _against(rows.select(*dict.fromkeys([*keep, key, vector])), vector, asked).select("query_id", *keep, key, "distance")
        # nulls are last, so they are left out after the rank and the distance is computed once
        return at.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & F.col("distance").isNotNull())

    return _in_blocks(queries, near, block)


def context_search(rows: DataFrame, key: str, vector: str, text: str, queries: DataFrame, k: int, block: int = MAX_QUERIES) -> DataFrame:
    """Similar rows that are neither the query's own text nor start with the same 200 characters as a better one.

    queries: (query_id, query_vector, query_text), taken in blocks as in :func:`knn`.
    """
    # each head counts once, by its nearest row, before the cut to k, so no near copy can push others out
    heads = rows.select(key, vector, text, F.left(F.coalesce(F.col(text), F.lit("")), F.lit(200)).alias("head"))
    order = W.partitionBy("query_id").orderBy("b.distance", f"b.{key}")

    def near(asked: DataFrame) -> DataFrame:
        # rows of one head lie together, so only the best heads of each partition are shuffled
        at = _against(heads.repartition("head"), vector, asked).where(~F.coalesce(F.col(text) == F.col("query_text"), F.lit(False)))
        best = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", key)))
        at = at.groupBy("query_id", "head").agg(best.alias("b")).where("b is not null")
        return at.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", f"b.{key}", "b.distance", "rank")

    return _in_blocks(queries, near, block)


def canary(before: DataFrame, after: DataFrame, key: str, vector: str, degraded_below: float = 0.95) -> DataFrame:
    """One row: mean cosine between two embeddings of the same rows, share of degraded rows, mean variance per dimension."""
    both = before.select(key, F.col(vector).alias("a")).join(after.select(key, F.col(vector).alias("b")), key).withColumn("c", cosine(F.col("a"), F.col("b")))
    quality = both.agg(F.count("*").alias("rows"), F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.avg((F.col("c") < degraded_below).cast("double")), 6).alias("degraded"))
    spread = after.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.round(F.avg("v"), 6).alias("mean_variance"))
    return quality.crossJoin(F.broadcast(spread))
