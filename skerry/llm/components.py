"""Connected components of a large edge list, by alternating star contraction.

Each round points every node's neighbours at the smallest node it knows, first those above
it (large star), then those below (small star); what is left is a star around the smallest
node of each component. Rounds write their edges to the shared folder. Nothing is collected
but a count and a checksum; a node's neighbours are never gathered, only their minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, upper: bool) -> DataFrame:
    """edges: a > b. upper: also from b's side, so that larger neighbours move."""
    if upper:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low"))
        moved = both.where("b > a").select(F.col("a").alias("node"), F.col("b").alias("v")).join(least, "node").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        joined = edges.select(F.col("a").alias("node"), F.col("b").alias("v")).join(least, "node")
        moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its component's smallest node) of every node of `edges` (a, b; longs)."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, last = materialise(now, "edges"), None
    for _ in range(most):
        now = materialise(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
