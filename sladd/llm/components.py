"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import written


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; ``root`` is the smallest node of the component.

    Each round is written to the shared folder. Minima are taken with partial sums, so a node with very many neighbours is no
    hot group; the number of rounds grows with the logarithm of the longest path.
    """
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = _neighbours(current)
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        after = written(small.filter("a <> b").distinct())
        if after.count() == current.count() and after.exceptAll(current).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        current = after
