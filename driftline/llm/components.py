"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def mark(edges: DataFrame) -> tuple:
    """Equal for equal tables of distinct edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return row["n"], row["s"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of ``edges`` (u, v) but the least of its component, with that least node as v.

    Each step shuffles edges and tables of one row per node. The least neighbours are stored before they are joined, so that
    Spark splits the edges of a hub over tasks. The number of steps grows with the logarithm of a component's diameter.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (found := mark(now)) != before:
        before = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")).select("of", F.least("of", "m").alias("m")), "least")
        # every larger neighbour is tied to the least of the neighbourhood
        large = staged(both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        below = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
        small = large.join(below, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select(F.col("of").alias("u"), F.col("m").alias("v")))
        discard(now, least)
        now = staged(small.where("u <> v").distinct(), "small-star")
        discard(large)
    return now
