"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) for every node of edges (a, b), which must be numbers.

    Each step writes as many edges as it has read at most; hubs cost one row for each neighbour. Self-loops, repeated
    edges and nulls do no harm. Raises if most_rounds, far above the logarithm of any graph's size, do not suffice.
    """
    now = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    checksum = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    before = None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now).where("a != b").distinct()).where("a != b").distinct(), "edges")
        if (seen := tuple(checksum(now))) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
