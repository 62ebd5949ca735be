"""Connected components of an edge table, by alternating large and small stars.

All work is joins and aggregations; the driver sees one count a round. Rounds
write their edges to the shared folder, so a lost executor costs one round. Each
node's least neighbour is written before it is joined back: the two sides are then
plain shuffles, of which adaptive execution splits a hub's edges over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung to its least neighbour."""
    near = _both_ways(edges)
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return near.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung to the least of these; edges have a > b."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs), any direction; gives node, root (the least node of its component).

    Nodes without an edge, and loops, are left out. A chain of n nodes takes about
    log2(n) rounds; that it doesn't end within `most_rounds` is an error.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        after = written(_small_star(written(_large_star(now), "edges")), "edges")
        # The stars are fixed when a round leaves count and sum of hashes unchanged.
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components need more than {most_rounds} rounds")
