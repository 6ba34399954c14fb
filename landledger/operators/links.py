"""Pointer doubling and connected components on small link tables (merges), by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise



def _cut(df: DataFrame) -> DataFrame:
    return materialise(df, "links")


def double_pointers(links: DataFrame) -> DataFrame:
    """property_id, survivor_id.  ``links``: property_id, merged_into_id (null or own id: none)."""
    now = _cut(links.filter("merged_into_id is not null and merged_into_id <> property_id").select("property_id", F.col("merged_into_id").alias("to")))
    now = now.withColumn("low", F.least("property_id", "to"))
    # Each round doubles how far a pointer reaches: after so many a chain of all links is resolved, and what still moves is a cycle.
    for _ in range(now.count().bit_length() + 1):
        nxt = now.select(F.col("property_id").alias("to"), F.col("to").alias("_far"), F.col("low").alias("_low"))
        step = now.join(nxt, "to", "left").select("property_id", F.coalesce("_far", "to").alias("new"), "to", F.least("low", F.coalesce("_low", "low")).alias("low"))
        step = _cut(step)
        settled = step.filter("new <> to").isEmpty()
        now = step.select("property_id", F.col("new").alias("to"), "low")
        if settled:
            break
    # Whoever still points at a merged property is in a cycle: its smallest id survives.
    ends = now.select(F.col("property_id").alias("to"), F.lit(1).alias("_c"))
    return now.join(ends, "to", "left").select("property_id", F.when(F.col("_c").isNull(), F.col("to")).otherwise(F.col("low")).alias("survivor_id"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of an undirected edge table u, v: minimum labels with pointer jumping."""
    both = _cut(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        step = label.join(near, "u").select("u", "c", F.least("c", "m").alias("n"))
        jump = label.select(F.col("u").alias("n"), F.col("c").alias("far"))
        step = _cut(step.join(jump, "n", "left").select("u", "c", F.least("n", F.coalesce("far", "n")).alias("n")))
        done = step.filter("n <> c").isEmpty()
        label = step.select("u", F.col("n").alias("c"))
        if done:
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
