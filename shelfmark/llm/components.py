"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges(a, b) of longs; the root is the smallest node. Nodes without edges don't occur."""
    spark = edges.sparkSession
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = materialize(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("root"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("root").alias("b"))
        after = materialize(small.filter("a <> b").distinct())
        discard(spark, current, large)
        current = after
    out = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node that points to none: the roots are then found."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = nodes.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 or (out = 1 and into = 1)").isEmpty()
