"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.plans.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large-star) or smaller (small-star) neighbours of each node to its least neighbour, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node with a link. ``edges`` has long columns ``a`` and ``b``; nulls and loops are left out.

    Each round is written to the shared folder. The rounds end when every link leads to a node that is the least of all its neighbours,
    which is known from two sums.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    state = None
    while True:
        now = written(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = (seen["n"], seen["h"])
