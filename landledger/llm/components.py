"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (map-side combined, so a hub is one row per task) and an equi-join back on
the node, whose hot keys the adaptive planner splits.  Labels halve their distance to the minimum in each round, edges never
multiply, and nothing but the number of edges and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` has u > v: all smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long).  Returns node, component (its smallest node) for every node with an edge to another."""
    e = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        e = materialise(_small_star(_large_star(e)), "edges", instead_of=e)
        mark = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = mark
