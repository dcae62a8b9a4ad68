"""Connected components of undirected links by alternating star operations.

Large-star links every larger neighbour to the smallest of a node's neighbourhood,
small-star links smaller neighbours and the node itself to it; both keep components
and end with one star per component. A hub's links are aggregated, never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.common import cut, drop_cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b for small-star input. Returns distinct (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    at = both.join(least, "a")
    if large:
        moved = at.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = at.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component) of all nodes in links (a, b); the component is its smallest node. Nulls and self-links link nothing. Raises if ``max_rounds`` do not suffice."""
    now = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        wide = cut(_star(now, large=True))
        new = cut(_star(wide, large=False))
        drop_cut(wide)
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_cut(now)
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
