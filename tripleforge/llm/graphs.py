"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, with_facts


def _least(rows: DataFrame, total: int) -> DataFrame:
    """a, b of ``rows`` with m, the smallest of a node and its neighbours there; a hub's rows are not gathered in one task."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("times")).withColumn("m", F.least("a", "m"))
    return with_facts(rows, least, "a", "times", total).drop("times")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable), for every node of ``edges`` (a, b) that has a link to another.

    Each step is two aggregations by minimum, reduced before they are shuffled, and two look-ups by node, in which hubs
    are broadcast (fewer than a fixed number) and all others joined.  The number of steps grows with the logarithm of the
    longest chain.  Links have ended changing when their number and the exclusive or of their hashes stay; neither can
    overflow.  Null nodes and links of a node to itself are left out; repeated links count once.
    """
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, 2 * sign[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least(durable(large), sign[0])
        now = durable(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct())
