"""Similarity join of bags over few tokens, such as normalised code.

Nearly every bag holds the frequent tokens, so a join on shared features lists nearly all pairs.
Here blocks of bags are compared with each other. Only sizes that can be alike meet; the overlap in
the block's frequent tokens is counted exactly, that in the others is bounded by their totals, and
what passes this bound is counted exactly too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.common import cut

#: Bags of a block, bags that it is compared with at once, tokens with a count of their own, buckets of size between alike bags, comparisons of a task.
BLOCK, AGAINST, DIMS, STEPS, WORK = 4096, 65_536, 31, 4, 20_000_000
#: Similarities are rounded to six places before they meet the threshold.
_SLACK = 1e-6


class _Bags:
    """Bags of a record batch: sizes, and tokens as positions in a vocabulary, without those it doesn't have."""

    def __init__(self, batch: pa.RecordBatch):
        self.keys = batch.column("k")
        self.n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column("xs")
        self.row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        self.x = lists.flatten().to_numpy(zero_copy_only=False)
        self.c = batch.column("cs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def lay(self, voc: np.ndarray, dim: np.ndarray, kind: type) -> None:
        """counts: the frequent tokens and, last, the total of the others, which lie in tail_*; dim: a token's place in it."""
        at = np.minimum(np.searchsorted(voc, self.x), len(voc) - 1)
        known = voc[at] == self.x
        row, at, c = self.row[known], at[known], self.c[known]
        own = dim[at] < DIMS
        self.counts = np.zeros((DIMS + 1, len(self.n)), kind)
        self.counts[dim[at[own]], row[own]] = c[own]
        self.tail_x, self.tail_c = at[~own], c[~own]
        self.counts[DIMS] = np.bincount(row[~own], weights=self.tail_c, minlength=len(self.n))
        self.tail_at = np.concatenate([[0], np.cumsum(np.bincount(row[~own], minlength=len(self.n)))])

    def tail(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in rows, that and the token as one rising number, count) of the other tokens of these rows."""
        many = self.tail_at[rows + 1] - self.tail_at[rows]
        place = np.repeat(np.arange(len(rows)), many)
        at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.tail_at[rows], many)
        return place, place * width + self.tail_x[at], self.tail_c[at]


def _common(a: _Bags, b: _Bags, i: np.ndarray, j: np.ndarray, bound: np.ndarray, width: int) -> np.ndarray:
    """The exact overlap of the pairs (i, j), whose bound is given."""
    exact = bound.astype(np.int64) - np.minimum(a.counts[DIMS, i], b.counts[DIMS, j])
    place, x, c = a.tail(i, width)
    _, y, d = b.tail(j, width)
    if len(x) and len(y):
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = y[at] == x
        exact += np.bincount(place[same], weights=np.minimum(c[same], d[at[same]]), minlength=len(i)).astype(np.int64)
    return exact


def _alike(a: _Bags, b: _Bags, least: float, width: int, rows: int = 256, columns: int = 2048, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of pairs of similarity ``least`` and more."""
    # by size, so that a part meets one stretch of the others
    ao, bo = np.argsort(a.n, kind="stable"), np.argsort(b.n, kind="stable")
    an, bn = a.n[ao], b.n[bo]
    ac, bc = np.ascontiguousarray(a.counts[:, ao]), np.ascontiguousarray(b.counts[:, bo])
    for i0 in range(0, len(ao), rows):
        i1 = min(len(ao), i0 + rows)
        first, end = np.searchsorted(bn, an[i0] * least - 1e-6), np.searchsorted(bn, an[i1 - 1] / least + 1e-6, side="right")
        for j0 in range(first, end, columns):
            j1 = min(end, j0 + columns)
            bound = np.zeros((i1 - i0, j1 - j0), ac.dtype)
            for d in range(DIMS + 1):
                bound += np.minimum(ac[d, i0:i1, None], bc[d, None, j0:j1])
            need = np.ceil((an[i0:i1, None] + bn[None, j0:j1]) * (least / (1 + least)) - 1e-6)
            p, q = np.nonzero(bound >= need)
            for at in range(0, len(p), most):
                pp, qq = p[at : at + most], q[at : at + most]
                i, j = ao[i0 + pp], bo[j0 + qq]
                common = _common(a, b, i, j, bound[pp, qq], width)
                good = common >= (a.n[i] + b.n[j] - common) * least
                yield i[good], j[good], common[good]


def _tasks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Batches in the order of unit and side: a block's bags first, then those that it is compared with."""
    unit, block, mine = None, [], None
    for batch in batches:
        u, side = batch.column("u").to_numpy(), batch.column("side").to_numpy()
        edges = np.flatnonzero((np.diff(u) != 0) | (np.diff(side) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(u)], strict=True):
            if hi == lo:
                continue
            part = batch.slice(lo, hi - lo)
            if u[lo] != unit:
                unit, block, mine = u[lo], [], None
            if side[lo] == 0:
                block.append(part)
                continue
            if not block:
                continue
            if mine is None:
                mine = _Bags(pa.Table.from_batches(block).combine_chunks().to_batches()[0])
                voc, where = np.unique(mine.x, return_inverse=True)
                dim = np.full(len(voc), DIMS)
                often = np.argsort(-np.bincount(where, weights=mine.c), kind="stable")[:DIMS]
                dim[often] = np.arange(len(often))
            other = _Bags(part)
            kind = np.uint16 if max(mine.n.max(), other.n.max()) < 1 << 16 else np.int64
            mine.lay(voc, dim, kind)
            other.lay(voc, dim, kind)
            same = part.column("b").to_numpy() == block[0].column("b")[0].as_py()
            for i, j, common in _alike(mine, other, least, len(voc)):
                a, b = mine.keys.take(pa.array(i)), other.keys.take(pa.array(j))
                # two bags of one bucket meet twice
                kept = pc.fill_null(pc.if_else(pa.array(same[j]), pc.less(a, b), pc.not_equal(a, b)), False)
                out = pa.RecordBatch.from_arrays([a, b, pa.array(common), pa.array(mine.n[i] + other.n[j])], names=["a", "b", "common", "total"])
                yield out.filter(kept)


def bag_join(bags: DataFrame, key: str, bag: str, threshold: float, block: int = BLOCK, against: int = AGAINST) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of bags (see :func:`duplicates.counted`) of at least that Jaccard similarity, min over max.

    Exact, without caps; empty bags are similar to nothing. Work grows as the square of the bags of like size, with a small factor, and so may the result.
    """
    spark = bags.sparkSession
    least = threshold - _SLACK
    # buckets of alike bags are at most STEPS apart
    width = -math.log(max(least - _SLACK, 1e-9)) / STEPS
    n = F.aggregate(bag, F.lit(0).cast("bigint"), lambda s, x: s + x["c"])
    s = bags.where(F.size(bag) > 0).select(F.col(key).alias("k"), n.alias("n"), F.col(f"{bag}.x").alias("xs"), F.col(f"{bag}.c").alias("cs"))
    s = cut(s.withColumn("b", F.floor(F.log("n") / width)))
    counts = {r["b"]: r["n"] for r in s.groupBy("b").agg(F.count("*").alias("n")).collect()}
    plan, pairs, units, work = [], [], 0, 0
    for b in sorted(counts):
        near = [c for c in range(b, b + STEPS + 1) if c in counts]
        others = sum(counts[c] for c in near)
        blocks, stretches = math.ceil(counts[b] / block), math.ceil(others / against)
        plan.append((b, units, blocks, stretches))
        pairs += [(c, b) for c in near]
        units += blocks * stretches
        work += counts[b] * others
    at = spark.createDataFrame(plan, "at bigint, base bigint, blocks bigint, stretches bigint")
    near = spark.createDataFrame(pairs, "b bigint, at bigint").join(F.broadcast(at), "at")
    h, g = (F.shiftrightunsigned(F.xxhash64("k", F.lit(i)), 1) for i in (3, 5))
    row = ["b", "k", "n", "xs", "cs"]
    stretch, piece = h % F.col("stretches"), g % F.col("blocks")
    own = s.join(F.broadcast(at.withColumnRenamed("at", "b")), "b").select(*row, "base", "stretches", piece.alias("p"), F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("q"), F.lit(0).alias("side"))
    others = s.join(F.broadcast(near), "b").select(*row, "base", "stretches", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), stretch.alias("q"), F.lit(1).alias("side"))
    both = own.unionByName(others).select((F.col("base") + F.col("p") * F.col("stretches") + F.col("q")).alias("u"), "side", *row)
    tasks = max(1, min(units, math.ceil(work / WORK)))
    kind = s.schema["k"].dataType.simpleString()
    found = both.repartition(tasks, "u").sortWithinPartitions("u", "side").mapInArrow(lambda it: _tasks(it, least), f"a {kind}, b {kind}, common bigint, total bigint")
    jaccard = F.round(F.col("common") / (F.col("total") - F.col("common")), 6)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
