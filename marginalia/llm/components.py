"""Connected components of a large sparse graph, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds: each round points nodes at
    smaller neighbours, so the number of rounds grows with the logarithm of the
    longest path, and no round emits pairs within a component. Each round's
    edges are written to the shared folder, which cuts the lineage.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialise(linked(edges), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: the larger neighbours of a node point at the smallest of it and its neighbours.
        both = now.select(F.col("a").alias("n"), F.col("b").alias("m")).union(now.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("a"), F.col("low").alias("b"))
        large = materialise(linked(large), "edges")
        # Small star: a node's smaller neighbours and itself point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        now = materialise(linked(small), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
