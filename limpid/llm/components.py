"""Connected components of a link table, by alternating star contractions.

Every round joins and aggregates by key with map-side combination and is written to the shared folder, so no set of
links or components is ever held by the driver or by one task, and a lost executor costs at most one round.  Links of
a hub node meet in a join without an aggregation above it, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the least of them.  Needs a > b in every row."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long; any direction, repeats and loops allowed), where
    component is the least node reachable.  An empty table gives an empty table."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _digest(now)
    while seen[0]:
        now = stage(_small_star(stage(_large_star(now), "large-star")), "small-star")
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
