"""A stored vector index: rows lie by the cell of their nearest centroid, a search reads the cells nearest to its queries.

Centroids are fitted on a bounded sample; every row with a vector that can be compared is indexed. Rows are range
partitioned and sorted by cell, so a filter on cells skips files and row groups by their statistics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators.vector import MAX_QUERIES, _in_blocks, not_zero

#: Sampled vectors for each cell, and the most that come to the driver.
PER_CELL, MOST_SAMPLED = 64, 200_000
ROUNDS = 8


def _unit(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    near = x @ centroids.T
    n = min(n, len(centroids))
    return np.argpartition(-near, n - 1, axis=1)[:, :n]


def fitted_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on the sphere; an empty cell takes the vector that fits worst."""
    x = _unit(sample)
    rnd = np.random.default_rng(seed)
    c = x[rnd.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = ~np.isin(np.arange(len(c)), own)
        worst = np.argsort(near.max(axis=1))[: int(empty.sum())]
        sums[np.nonzero(empty)[0][: len(worst)]] = x[worst]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def _best(batches: Iterator[pd.DataFrame], key: str, ids: list[str], queries: np.ndarray, cells: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The best k rows of every batch for each query, among the rows of the query's cells."""
    for pdf in batches:
        if not len(pdf):
            continue
        out = []
        for cell, part in pdf.groupby("cell", sort=False):
            asks = np.nonzero((cells == cell).any(axis=1))[0]
            if not len(asks):
                continue
            distance = np.round(1 - queries[asks] @ _unit(np.stack(part["vector"].to_list())).T, 6)
            # all that tie with the k-th stay, the final rank decides by key
            n = min(k, distance.shape[1])
            edge = np.partition(distance, n - 1, axis=1)[:, n - 1]
            q, r = np.nonzero(distance <= edge[:, None])
            out.append(pd.DataFrame({"query_id": [ids[asks[i]] for i in q], key: part[key].to_numpy()[r], "distance": distance[q, r]}))
        if out:
            yield pd.concat(out)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    key_type: str
    centroids: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, vector: str, cells: int | None = None) -> VectorIndex:
        """rows: a key and a vector of one length. ``cells`` defaults to the root of their number.

        At most ``MOST_SAMPLED`` vectors, ``PER_CELL`` a cell, are sampled by the hash of their key to fit the centroids. Null and zero
        vectors cannot be found and are left out; an empty table makes an index that finds nothing.
        """
        spark = rows.sparkSession
        vec = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & not_zero(vector, 1e-30)).select(key, F.col(vector).cast("array<float>").alias("vector"))
        n = vec.count()
        cells = cells or max(1, int(n**0.5))
        wanted = min(MOST_SAMPLED, PER_CELL * cells, max(n, 1))
        share = wanted / max(n, 1)
        sample = vec.where(F.shiftrightunsigned(F.xxhash64(key), 11) * F.lit(2.0**-53) < share).select("vector").limit(2 * wanted).toPandas()["vector"]
        if n and not len(sample):
            sample = vec.limit(1).select("vector").toPandas()["vector"]
        centroids = fitted_centroids(np.stack(sample.to_list()), cells) if n else np.zeros((0, 1))
        kind = rows.schema[key].dataType.simpleString()
        made = cls(spark, path.rstrip("/"), key, kind, centroids)
        shared = spark.sparkContext.broadcast(centroids)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=_nearest_cells(_unit(np.stack(pdf["vector"].to_list())), shared.value, 1)[:, 0].astype(np.int32))

        schema = T.StructType([*vec.schema.fields, T.StructField("cell", T.IntegerType())])
        placed = vec.mapInPandas(place, schema)
        # cells of one range lie together; a cell of many rows is spread by the key
        placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.parquet(f"{made.path}/rows")
        meta = json.dumps({"key": key, "type": kind, "centroids": centroids.tolist()})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.parquet(f"{made.path}/meta")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return cls(spark, path.rstrip("/"), meta["key"], meta["type"], np.array(meta["centroids"]))

    def search(self, queries: DataFrame, k: int, probes: int = 16, block: int = MAX_QUERIES) -> DataFrame:
        """(query_id, key, distance, rank): the ``k`` nearest by cosine distance among the rows of each query's ``probes`` cells.

        queries: (query_id, query_vector), any number, taken in blocks of ``block``. With as many probes as cells the result is exact.
        """
        schema = f"query_id string, `{self.key}` {self.key_type}, distance double"
        order = W.partitionBy("query_id").orderBy("distance", self.key)

        def near(asked: DataFrame) -> DataFrame:
            known = asked.where(F.col("query_vector").isNotNull() & not_zero("query_vector", 1e-30)).select(F.col("query_id").cast("string"), F.col("query_vector").cast("array<double>")).toPandas()
            if not len(known) or not len(self.centroids):
                return self.spark.createDataFrame([], f"{schema}, rank int")
            q = _unit(np.stack(known["query_vector"].to_list()))
            cells = _nearest_cells(q, self.centroids, probes)
            ids, key = known["query_id"].tolist(), self.key
            shared = self.spark.sparkContext.broadcast((q, cells))
            rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin([int(c) for c in np.unique(cells)]))
            found = rows.mapInPandas(lambda it: _best(it, key, ids, *shared.value, k), schema)
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        return _in_blocks(queries, near, block)
