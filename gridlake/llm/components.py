"""Connected components of a graph that is too large for any one machine: alternating large and small stars.

Each step is one aggregation (least neighbour) and one join, both on a node; hot nodes are combined before the shuffle
and split by Spark's skew join. The edges are cut to the shared folder after each round, so a lost executor costs one
round at most. Nothing is collected but one row that tells whether the round changed the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Rounds needed grow with the logarithm of the longest path; beyond this many something is wrong.
MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("m", "u").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_least(both), F.col("u") == F.col("node")).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them. Edges point to the smaller node."""
    least = _least(edges)
    linked = edges.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Loops and repeated edges do no harm, rows with a null end are left out, no edges give no rows.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = cut(start), None
    for _ in range(MOST_ROUNDS):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        release(edges.sparkSession)
        current = cut(_small_star(_large_star(current).distinct()).distinct())
    raise RuntimeError("the components did not settle")
