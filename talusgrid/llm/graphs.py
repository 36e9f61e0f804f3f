"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour per left node; partial minima come before the shuffle, so a hub is no hot group."""
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any ordered type -> (node, component): the smallest node that its edges reach.

    Nodes without an edge to another node do not appear. Every round halves distances at least, and each is written
    to the shared folder, so a lost executor costs one round at most. Only a count and a checksum reach the driver.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stored(large, "large-star")
        least = _lowest(large)
        moved = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
