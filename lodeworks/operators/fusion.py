"""Ranks, fusion of ranked lists, boosts, deduplication and diversification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import union_all

RRF_K = 60
#: Extensions of code and of documents.
CODE_EXTENSIONS = [".py", ".rs", ".js", ".ts", ".go", ".cpp", ".c", ".h", ".hpp", ".java", ".json", ".toml", ".yaml", ".yml"]
DOCS_EXTENSIONS = [".md", ".txt", ".rst", ".log"]
DOC_SUFFIX = r"(?i)\.(md|markdown|rst|txt|ipynb)$"


def ranked(scores: DataFrame, group: str, key: str, score: str = "score") -> DataFrame:
    """(group, key, rank): 1-based rank by falling score, ties to the smaller key."""
    order = W.partitionBy(group).orderBy(F.desc(score), key)
    return scores.select(group, key, F.row_number().over(order).alias("rank"))


def fused(lists: list[DataFrame], group: str, key: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists."""
    total = union_all(lists).groupBy(group, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    order = W.partitionBy(group).orderBy(F.desc("score"), key)
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def position_scores(lists: DataFrame, group: str, rank: str = "rank") -> Column:
    """1 for the first of a list falling evenly to 1/n for the last."""
    return 1 - (F.col(rank) - 1) / F.count("*").over(W.partitionBy(group))


def weighted_fusion(base: DataFrame, rerank: DataFrame, group: str, key: str, exact: Column, base_weight: float = 0.3, rerank_weight: float = 0.7) -> DataFrame:
    """Position scores of two rankings weighted, times 1.5 for an exact match."""
    a = base.select(group, key, position_scores(base, group).alias("a"))
    b = rerank.select(group, key, position_scores(rerank, group).alias("b"))
    both = a.join(b, [group, key], "left").withColumn("s", base_weight * F.col("a") + rerank_weight * F.coalesce("b", F.lit(0.0)))
    return both.select(group, key, F.round(F.col("s") * F.when(exact, 1.5).otherwise(1.0), 9).alias("score"))


def extension(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"[^/\\](\.[^./\\]*)$", 1))


def bucket_weight(path: str | Column, intent: Column, code: float = 1.0, docs: float = 0.5) -> Column:
    """Weight by kind of file, 20 % up or down by what the query looks for."""
    ext = extension(path)
    up, down = F.lit(1.2), F.lit(0.8)
    code_w = F.lit(code) * F.when(intent == "code", up).when(intent == "docs", down).otherwise(1.0)
    docs_w = F.lit(docs) * F.when(intent == "docs", up).when(intent == "code", down).otherwise(1.0)
    return F.when(ext.isin(CODE_EXTENSIONS), code_w).when(ext.isin(DOCS_EXTENSIONS), docs_w).otherwise(1.0)


def cochange_boost(results: DataFrame, coupling: DataFrame, group: str, key: str, top: int = 3) -> DataFrame:
    """Scores x (1 + 0.3 x highest coupling with one of the ``top`` files of the same list).

    results: (group, key, file_path, score); coupling: (file_a, file_b, coupling), each pair once.
    """
    order = W.partitionBy(group).orderBy(F.desc("score"), key)
    heads = results.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select(group, F.col("file_path").alias("head")).distinct()
    both = coupling.select(F.col("file_a").alias("head"), F.col("file_b").alias("file_path"), "coupling").unionByName(
        coupling.select(F.col("file_b").alias("head"), F.col("file_a").alias("file_path"), "coupling")
    )
    best = heads.join(both, "head").groupBy(group, "file_path").agg(F.max("coupling").alias("c"))
    up = results.join(best, [group, "file_path"], "left")
    return up.withColumn("score", F.round(F.col("score") * (1 + 0.3 * F.coalesce("c", F.lit(0.0))), 9)).drop("c")


def exact_name(query: Column, name: Column, text: Column) -> Column:
    """A chunk whose symbol is, or contains, the query's identifier, or whose text defines or calls it."""
    q = F.trim(query)
    last = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"::|\."), -1))
    called = F.regexp_like(text, F.concat(F.lit(r"\b"), q, F.lit(r"\s*\(")))
    return (q != "") & (last != "") & ((last == F.lower(q)) | F.contains(last, F.lower(q)) | F.coalesce(called, F.lit(False)))


def exact_boost(results: DataFrame, group: str, key: str, exact: Column, path: str, factor: float = 100.0) -> DataFrame:
    """Boosted rows first: exact names in code x ``factor``, documents never (R17, L9). Adds ``rank``."""
    boosted = exact & ~F.coalesce(F.col(path).rlike(DOC_SUFFIX), F.lit(False))
    out = results.withColumn("boosted", boosted).withColumn("score", F.when(F.col("boosted"), F.col("score") * factor).otherwise(F.col("score")))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("boosted"), F.desc("score"), key)))


def prepend_missing(results: DataFrame, exact_hits: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Exact hits that the list lacks come first, the list is cut to ``k`` (R18). Both have (group, key, rank)."""
    missing = exact_hits.join(results.select(group, key), [group, key], "left_anti").select(group, key, F.lit(0).alias("tier"), "rank")
    both = missing.unionByName(results.select(group, key, F.lit(1).alias("tier"), "rank"))
    order = W.partitionBy(group).orderBy("tier", "rank", key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("tier")


def best_per(results: DataFrame, group: list[str], key: str, score: str = "score") -> DataFrame:
    """The best row of each group; ties to the smaller key."""
    order = W.partitionBy(*group).orderBy(F.desc(score), key)
    return results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def min_max(score: str, group: str) -> Column:
    """Scores of a list on 0..1; a list of equal scores has 1."""
    w = W.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.coalesce(F.try_divide(F.col(score) - lo, hi - lo), F.lit(1.0))


def score_floor(results: DataFrame, group: str, floor: float = 0.3) -> DataFrame:
    """Rows at or above the floor; a list without any keeps all."""
    kept = F.sum((F.col("score") >= floor).cast("int")).over(W.partitionBy(group))
    return results.withColumn("_n", kept).where((F.col("score") >= floor) | (F.col("_n") == 0)).drop("_n")


def _mmr(pdf: pd.DataFrame, group: str, key: str, k: int, trade: float) -> pd.DataFrame:
    pdf = pdf.sort_values([key]).reset_index(drop=True)
    x = np.array(pdf["vector"].tolist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    s = pdf["score"].to_numpy(dtype=np.float64)
    spread = s.max() - s.min()
    relevance = (s - s.min()) / spread if spread > 0 else np.ones_like(s)
    closest = np.full(len(s), -np.inf)
    free = np.ones(len(s), dtype=bool)
    picks = []
    for r in range(min(k, len(s))):
        value = trade * relevance - (1 - trade) * (closest if r else 0.0)
        value = np.round(np.where(free, value, -np.inf), 9)
        best = int(value.argmax())
        picks.append((pdf[group][best], pdf[key][best], r + 1, float(value[best])))
        free[best] = False
        closest = np.maximum(closest, x @ x[best])
    return pd.DataFrame(picks, columns=[group, key, "rank", "value"])


def mmr(candidates: DataFrame, group: str, key: str, k: int = 10, trade: float = 0.6, most: int = 30) -> DataFrame:
    """Greedy maximal marginal relevance per list.

    candidates: (group, key, score, vector). The best ``most`` of each list take part, so a group is
    bounded however long its list is; that bound is the operator's own over-fetch.
    """
    order = W.partitionBy(group).orderBy(F.desc("score"), key)
    top = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return top.groupBy(group).applyInPandas(lambda pdf: _mmr(pdf, group, key, k, trade), f"{group} {types[group]}, {key} {types[key]}, rank int, value double")
