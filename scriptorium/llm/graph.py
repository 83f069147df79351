"""Connected components by alternating large and small stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v of a u beside the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of bigint nodes, repeats and loops allowed: (node, root), root the least node reachable.

    Only nodes with an edge to another node appear; an empty table of edges gives an empty table.
    Each round halves the trees' depth or better; a run that doesn't settle raises an error.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # a > b throughout. Large star: every larger neighbour of u goes to u's least neighbour.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours go to the least of them.
        least = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = least.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
