"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b): the smallest node that links reach.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes, which takes
    about the logarithm of the longest path. Every round moves the table of links once for each
    half, never a component as a whole, and is written to the shared folder. Aggregates are taken
    before rows move; a node with very many links is a plain join, which adaptive execution splits.
    """
    current = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "star")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: link every larger neighbour of a node to the least of its neighbourhood.
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = stored(large, "large-star")
        # Small star: link a node and its smaller neighbours to the least of them.
        low = stored(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("n")).where("m < n")
        small = stored(small.select(F.col("m").alias("a"), F.col("n").alias("b")).distinct(), "small-star")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current, least, large, low)
        current = small
        if state == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = state
