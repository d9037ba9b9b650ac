"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``), the component being its smallest node.

    Alternates large-star and small-star steps until nothing changes: every node points at the smallest neighbour it
    knows. The rounds grow with the logarithm of the longest chain, the rows never exceed the edges. A node with very
    many neighbours is a key of many rows, so its minimum is taken by a map-side aggregate and joined back to rows
    that adaptive execution may split; no neighbour list is collected.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Large star: larger neighbours of a node move to the smallest node of its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = checkpointed(small.where("a <> b").distinct())
        if not _differ(links, small):
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        links = small


def _differ(one: DataFrame, other: DataFrame) -> bool:
    """Whether two edge lists differ, by count and an order-free digest."""

    def digest(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()

    return digest(one) != digest(other)
