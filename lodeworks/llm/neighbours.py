"""Most similar vectors for every vector.

A block matrix join. Pivots are a sample of the vectors in proportion to their number, so a cell
holds about ``CELL`` vectors at any size and dense regions have as many more pivots as they have
vectors. They are found in two steps, a coarse pivot (the root of their number) and then the
pivots nearest to it. Each vector lies in the cells of its ``probes`` nearest pivots; a
cell of far more vectors than usual is cut into blocks. For each pair of blocks of a cell, one
tile is computed from int8 copies: integer products with a bound on the quantisation
error. Pairs that the bound does not rule out are recomputed in double
precision, and per-vector heaps keep the best, so a tile emits at most k rows a vector. Equal
vectors are one class, so copies, however many, take part once; their own lists are
expanded at the end. Vectors that found fewer than k others in their cells are compared
with all vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut, union_all

CELL = 2_000
PROBES, COARSE_PROBES = 4, 24
BLOCK = 6_000
#: Pivots that one pass broadcasts, 64 MB at 64 dimensions; with more the pivots are gone through in parts.
PART = 250_000


def comparable(vector: str, dim: int):
    """Vectors that can be compared: right length, no null or non-finite entry, not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)
    # scale by the largest entry first: squares of very large or small entries must not overflow or vanish
    d /= np.abs(d).max(axis=1, keepdims=True)
    return d / np.sqrt((d * d).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = np.array(pdf["vector"].tolist(), dtype=np.float32)
        yield pd.DataFrame({"id": pdf["id"], "raw": [r.tobytes() for r in raw], "h1": pdf["h1"], "h2": pdf["h2"]})


def _place(batches: Iterator[pd.DataFrame], coarse: np.ndarray, fine: dict[int, tuple[np.ndarray, np.ndarray]], probes: int) -> Iterator[pd.DataFrame]:
    """Each vector's best ``probes`` cells among those under its nearest coarse pivots, with their cosines.

    fine: per coarse pivot the numbers and vectors of the pivots nearest to it.
    """
    wide = min(COARSE_PROBES, len(coarse))
    for pdf in batches:
        if not len(pdf):
            continue
        x = _unit(_matrix(pdf["raw"])).astype(np.float32)
        near = x @ coarse.T
        at = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        cells = np.full((len(x), 0), -1, np.int64)
        cosines = np.full((len(x), 0), -2, np.float32)
        for slot in range(wide):
            own = np.full((len(x), probes), -1, np.int64)
            cos = np.full((len(x), probes), -2, np.float32)
            for c in np.unique(at[:, slot]):
                if int(c) not in fine:
                    continue
                numbers, pivots = fine[int(c)]
                who = np.nonzero(at[:, slot] == c)[0]
                sims = x[who] @ pivots.T
                n = min(probes, len(numbers))
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                own[who, :n] = numbers[top]
                cos[who, :n] = np.take_along_axis(sims, top, axis=1)
            cells, cosines = np.concatenate([cells, own], axis=1), np.concatenate([cosines, cos], axis=1)
        order = np.argsort(-cosines, axis=1, kind="stable")[:, :probes]
        cells, cosines = np.take_along_axis(cells, order, axis=1), np.take_along_axis(cosines, order, axis=1)
        yield pd.DataFrame({"id": pdf["id"], "raw": pdf["raw"], "cells": [c[c >= 0] for c in cells], "cosines": [v[c >= 0] for c, v in zip(cells, cosines, strict=True)]})


def _spread(batches: Iterator[pd.DataFrame], blocks: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows for the tiles. A tile is (cell, a, b), a <= b; a row of block own is in the tiles (a, own) and (own, b).

    blocks names the cells that are cut, with the number of their blocks.
    """
    for pdf in batches:
        ids, raws, cell, a, b, mine = [], [], [], [], [], []
        for key, raw, cells, h in zip(pdf["id"], pdf["raw"], pdf["cells"], pdf["h"], strict=True):
            for c in cells:
                n = blocks.get(int(c), 1)
                own = int(h) % n
                for other in range(n):
                    ids.append(key)
                    raws.append(raw)
                    cell.append(c)
                    a.append(min(own, other))
                    b.append(max(own, other))
                    mine.append(own)
        yield pd.DataFrame({"id": ids, "raw": raws, "cell": np.array(cell, np.int64), "a": np.array(a, np.int32), "b": np.array(b, np.int32), "own": np.array(mine, np.int32)})


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding lost, of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, lost


def survivors(x: np.ndarray, y: np.ndarray, least: float, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach ``least``, and may be among the k best of row i, by int8 products and their error bounds.

    With x = s q + e the true product differs from s_i s_j q_i q_j by at most
    |e_i| + |e_j| (1 + |e_i|). The integers are multiplied as float32, in which sums up to 2^24
    are exact, far above 127 * 127 * 64. With ``k`` a pair stays only if its upper bound reaches
    the k-th best lower bound of its row.
    """
    qx, sx, ex = quantised(x)
    qy, sy, ey = quantised(y)
    upper = qx.astype(np.float32) @ qy.astype(np.float32).T
    upper *= sx[:, None].astype(np.float32)
    upper *= sy[None, :].astype(np.float32)
    slack = (ey * (1 + ex.max())).astype(np.float32)
    upper += slack[None, :]
    # what a row's products with the slack of the other side must reach, less its own loss
    reach = np.full(len(x), least, dtype=np.float32) - ex.astype(np.float32)
    if k is not None and len(y) > k and (least <= -1 or np.count_nonzero(upper >= reach[:, None]) > 4 * k * len(x)):
        kth = np.partition(upper - 2 * slack[None, :], len(y) - k, axis=1)[:, len(y) - k]
        reach = np.maximum(reach, kth - 2 * ex.astype(np.float32))
    i, j = np.nonzero(upper >= reach[:, None] - np.float32(2e-5))
    return i, j


def _best_of(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray, k: int, least: float, out: list) -> None:
    """Appends (u, v, cosine) of the up to k best rows of y for each row of x; a row is no neighbour of itself."""
    step = max(1, 8_000_000 // max(len(y), 1))
    for top in range(0, len(x), step):
        part = x[top : top + step]
        # one more, for the row itself may be among them
        i, j = survivors(part, y, least, k + 1)
        own = u[top + i] != v[j]
        i, j = i[own], j[own]
        cos = (part[i] * y[j]).sum(axis=1)
        near = cos >= least
        i, j, cos = i[near], j[near], cos[near]
        for row, a, b in zip(*_runs(i), strict=True):
            best = heapq.nsmallest(k, zip(-cos[a:b], v[j[a:b]], strict=True))
            out.extend((u[top + row], other, -float(c)) for c, other in best)


def _runs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array with the bounds of their runs."""
    rows, first = np.unique(i, return_index=True)
    return rows, first, np.append(first[1:], len(i)) if len(rows) else first


def _tile(pdf: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
    pdf = pdf.sort_values("id")
    rows: list[tuple[str, str, float]] = []
    left, right = (pdf, pdf) if a == b else (pdf[pdf["own"] == a], pdf[pdf["own"] == b])
    if len(left) and len(right):
        x, u = _unit(_matrix(left["raw"])), left["id"].to_numpy()
        y, v = (x, u) if a == b else (_unit(_matrix(right["raw"])), right["id"].to_numpy())
        _best_of(x, u, y, v, k, least, rows)
        if a != b:
            _best_of(y, v, x, u, k, least, rows)
    return pd.DataFrame(rows, columns=["id", "other", "cos"])


def _ask_tile(pdf: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """One block of asking vectors against one block of all."""
    rows: list[tuple[str, str, float]] = []
    asks, base = pdf[pdf["ask"]].sort_values("id"), pdf[~pdf["ask"]].sort_values("id")
    if len(asks) and len(base):
        _best_of(_unit(_matrix(asks["raw"])), asks["id"].to_numpy(), _unit(_matrix(base["raw"])), base["id"].to_numpy(), k, least, rows)
    return pd.DataFrame(rows, columns=["id", "other", "cos"])


_FOUND = "id string, other string, cos double"


def _best(df: DataFrame, group: str, k: int) -> DataFrame:
    order = W.partitionBy(group).orderBy(F.desc("cos"), "other")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pivots(reps: DataFrame, total: int, wanted: int) -> np.ndarray:
    """About ``wanted`` vectors by the hash of their keys, without a sort; at least one."""
    if wanted <= 1:
        rows = reps.limit(1)
    else:
        share = min(1.0, wanted / total)
        rows = reps.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) * F.lit(2.0**-53) < share)
    got = rows.select("id", "raw").toPandas().sort_values("id")
    if not len(got):
        got = reps.limit(1).select("id", "raw").toPandas()
    return _unit(_matrix(got["raw"])).astype(np.float32)


def _placed(reps: DataFrame, total: int, probes: int, cell: int, part: int) -> tuple[DataFrame, int]:
    """(id, raw, cells) and the number of pivots."""
    spark = reps.sparkSession
    pivots = _pivots(reps, total, math.ceil(total * probes / cell))
    coarse = pivots[:: max(1, math.isqrt(len(pivots)))]
    home = np.concatenate([(pivots[i : i + 10_000] @ coarse.T).argmax(axis=1) for i in range(0, len(pivots), 10_000)])
    order = np.argsort(home, kind="stable")
    owners, first, last = _runs(home[order])
    groups = [(int(c), order[a:b]) for c, a, b in zip(owners, first, last, strict=True)]
    parts: list[dict] = [{}]
    held = 0
    for c, members in groups:
        if held and held + len(members) > part:
            parts.append({})
            held = 0
        parts[-1][c] = (members.astype(np.int64), pivots[members])
        held += len(members)

    def place(fine: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast((coarse, fine))
        return reps.mapInPandas(lambda it: _place(it, *shared.value, probes), "id string, raw binary, cells array<bigint>, cosines array<float>")

    if len(parts) == 1:
        return cut(place(parts[0]).select("id", "raw", "cells")), len(pivots)
    # a vector's cells of all parts are ranked together; vectors follow once the cells are known
    seen = union_all([cut(place(p).select("id", F.explode(F.arrays_zip("cells", "cosines")).alias("z"))) for p in parts])
    ranked = seen.select("id", F.col("z.cells").alias("cell"), F.col("z.cosines").alias("c"))
    order_by = W.partitionBy("id").orderBy(F.desc("c"), "cell")
    best = ranked.withColumn("r", F.row_number().over(order_by)).where(F.col("r") <= probes).groupBy("id").agg(F.collect_list("cell").alias("cells"))
    return cut(reps.join(best, "id").select("id", "raw", "cells")), len(pivots)


def _ask_all(asks: DataFrame, reps: DataFrame, asking: int, total: int, k: int, least: float, block: int) -> DataFrame:
    """The best k of all vectors for each of the few vectors in ``asks``: a block join without cells."""
    rows, columns = math.ceil(asking / block), math.ceil(total / block)
    h = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1)
    left = asks.select("id", "raw", (h % rows).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).cast("bigint").alias("b"), F.lit(True).alias("ask"))
    right = reps.select("id", "raw", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).cast("bigint").alias("a"), (h % columns).alias("b"), F.lit(False).alias("ask"))
    return left.unionByName(right).groupBy("a", "b").applyInPandas(lambda pdf: _ask_tile(pdf, k, least), _FOUND)


def nearest(
    df: DataFrame, key: str, vector: str, k: int = 5, least: float | None = None, dim: int = 64, probes: int = PROBES, cell: int = CELL, block: int = BLOCK, part: int = PART, exact: bool = False
) -> DataFrame:
    """(id, other, cos, rank): for each vector the ``k`` others of highest cosine.

    Keys are strings and unique. Vectors that cannot be compared (see
    :func:`comparable`) take no part. Ties go to the smaller key. With ``least`` only others of
    that cosine or more come out, so a vector may have fewer than k; without it a vector has k others
    wherever there are so many. A pair is missed only if its two vectors share none of their
    ``probes`` cells; recall is measured in the tests and the README. ``exact=True`` compares every block with
    every other: no pair is missed, and work and shuffle grow as the square of the vectors.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    floor = -2.0 if least is None else least
    vec = df.where(comparable(vector, dim)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    # equal vectors: two hashes of 64 bits, over the values and over their reverse
    hashed = vec.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.reverse("vector"), F.lit(7))})
    vec = cut(hashed.mapInPandas(_packed, "id string, raw binary, h1 bigint, h2 bigint"))
    classes = vec.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(vec.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep"))
    reps = vec.join(copies.where("id <> rep"), "id", "left_anti").select("id", "raw")
    total = vec.count() - copies.where("id <> rep").count()
    if total == 0:
        return spark.createDataFrame([], "id string, other string, cos double, rank int")
    if exact:
        placed, pivots = reps.withColumn("cells", F.array(F.lit(0).cast("bigint"))), 1
    else:
        placed, pivots = _placed(reps, total, probes, cell, part)
    # only cells beyond one block come to the driver, at most probes x total / block of them
    large = placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > block).collect()
    blocks = {r["cell"]: math.ceil(r["count"] / block) for r in large}
    spread = placed.select("id", "raw", "cells", F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1).alias("h")).mapInPandas(
        lambda it: _spread(it, blocks), "id string, raw binary, cell bigint, a int, b int, own int"
    )
    found = spread.groupBy("cell", "a", "b").applyInPandas(lambda pdf: _tile(pdf, k, floor), _FOUND)
    merged = cut(_best(found.groupBy("id", "other").agg(F.max("cos").alias("cos")), "id", k).select("id", "other", "cos"))
    if least is None and pivots > 1:
        short = reps.join(merged.groupBy("id").count().where(F.col("count") >= min(k, total - 1)), "id", "left_anti")
        short = cut(short)
        asking = short.count()
        if asking:
            whole = _best(_ask_all(short, reps, asking, total, k, floor, block), "id", k).select("id", "other", "cos")
            merged = cut(merged.join(short.select("id"), "id", "left_anti").unionByName(whole))
    # lists of classes: the smallest keys of each, found under a salt so that no task sees a whole class
    salted = W.partitionBy("rep", "salt").orderBy("id")
    first = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
    outer = merged.join(first.withColumnRenamed("rep", "other"), "other", "left").select(F.col("id").alias("rep"), F.coalesce("member", "other").alias("other"), "cos")
    inner = first.select("rep", F.col("member").alias("other"), F.lit(1.0).alias("cos"))
    lists = _best(outer.unionByName(inner), "rep", k + 1).select("rep", "other", "cos")
    ranked = lists.join(copies, "rep", "left").withColumn("id", F.coalesce("id", "rep")).where("id <> other").select("id", "other", "cos")
    return _best(ranked, "id", k).select("id", "other", "cos", "rank")


def similar_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) in which one is among the nearest of the other."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def brute_force(ids: list[str], vectors: list, k: int = 5, least: float | None = 0.9, dim: int = 64) -> set[tuple[str, str]]:
    """The exact pairs, for tests and recall on small data."""
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == dim and all(e is not None for e in v)]
    good = sorted((i, v) for i, v in good if np.isfinite(v).all() and v.any())
    if not good:
        return set()
    x = _unit(np.array([v for _, v in good], dtype=np.float32))
    names = [i for i, _ in good]
    out = set()
    for i, row in enumerate(x):
        cos = (x * row).sum(axis=1)  # the order of summation must not depend on the row's place
        cos[i] = -2
        top = heapq.nsmallest(k, np.nonzero(cos >= (-1.5 if least is None else least))[0], key=lambda j: (-cos[j], names[j]))
        out.update(starmap(lambda a, b: (min(a, b), max(a, b)), ((names[i], names[j]) for j in top)))
    return out
