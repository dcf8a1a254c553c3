"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node
    of the component. Self-loops, repeated edges and either direction are accepted; nulls
    are dropped. Each round costs two shuffles of the edges, and the rounds grow as the
    logarithm of the nodes. Nothing but two numbers a round reaches the driver.
    """

    def stars(pairs: DataFrame) -> DataFrame:
        """Each pair's far end, tied to the smallest neighbour of its near end."""
        low = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        return pairs.join(low, "a")

    def digest(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # a > b from here on
    edges = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges)
    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = stars(large)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).where("a > b").distinct()
        edges = written(small)
        after = digest(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
