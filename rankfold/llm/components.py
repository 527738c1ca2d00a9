"""Connected components of a graph in a DataFrame, by alternating large and small stars.

Each round is two aggregations and two joins on the node, all of which Spark can split when a node is hot; the
edge table is written to the shared folder after each round. Rounds grow with the logarithm of the node count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) with a != b, no nulls. Returns (node, root) for every node but the roots; root: the least node reachable."""
    edges = written(edges.distinct(), "edges")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # two numbers
        if state == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        large = written(_large_star(edges), "edges")
        small = written(_small_star(large), "edges")
        discard(edges, large)
        edges = small
