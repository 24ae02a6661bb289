"""Connected components of a graph held as a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied


def _stars(edges: DataFrame) -> DataFrame:
    """One round: each node's larger neighbours to its least one, then its smaller neighbours too."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of edges (a, b); loops and repeats don't matter.

    The rounds, about the logarithm of the longest path, go on until the graph is stars.  Each round's
    edges are no more than the last round's and are written to the checkpoint folder; the driver sees
    two numbers a round.  A node with very many neighbours is met by sums before joins, and its joins
    have one row a key on one side.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        # Stars: no centre is itself a leaf.
        with tidied(edges.sparkSession):
            seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            break
        mark, now = seen, cut(_stars(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
