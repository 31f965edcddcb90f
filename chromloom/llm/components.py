"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import by_real_sizes, collect_garbage, discard, written

#: Edges from which on a round's tables get another task; a small graph is not spread over all shuffle partitions.
EDGES_A_TASK = 50_000


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself: each class is a star about its least node."""
    above = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("b").alias("a")).distinct().withColumn("centre", F.lit(True))
    with by_real_sizes(edges.sparkSession):
        return above.join(centres, "a", "left").filter("n > 1 or centre").select("a").coalesce(tasks).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached, for each node of edges (a, b: integers) but the least ones themselves.

    Each round is two joins of the edges with the nodes' minima, which are pre-aggregated and written to the shared folder,
    so that a node with many neighbours is an ordinary skewed join key. Nothing is collected but a number and a flag a round:
    edges that are stars already get no round at all. A round's tables have tasks by the number of edges, and are deleted
    once the next ones are written; the driver's garbage is collected with them.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        tasks = 1 + math.ceil(edges.count() / EDGES_A_TASK)
        if _settled(edges, tasks):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(tasks))
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        used = (edges, least, large, lower)
        edges = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        for t in used:
            discard(t)
        collect_garbage(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
