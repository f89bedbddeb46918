"""Connected components by alternating star joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of ``edges`` (a, b: longs) that isn't its root.

    A large-star round links each node's larger neighbours to its smallest one, a small-star round its smaller ones. Both
    keep the components and the number of rounds grows with the logarithm of the nodes; edges that all lead to a root already
    need none. Sums per node are pre-aggregated and stored, so the joins have a table with one row a node on one
    side, and a node with very many neighbours is split like any skewed join's.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = store(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    while not stars(now):
        both = now.union(now.select("b", "a"))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large, "large")
        lowest = store(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(small.union(lowest).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or edges up only."""
    down = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = down.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down + up > 1").isEmpty()
