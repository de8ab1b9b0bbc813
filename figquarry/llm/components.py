"""Connected components by alternating large-star and small-star steps, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_apart, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


#: Edges that are written to one file at least.
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the least node that can be reached; nodes without edge have no row.

    Every round is a fixed number of shuffles over at most as many edges as came in; rounds grow with the logarithm
    of the longest chain. Each round is written, so that a lost executor costs one round at most. Loops and nulls are
    dropped, repeated edges count once.
    """
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_apart(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_apart(large, least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialise(small.coalesce(1 + state[0] // FILE_EDGES))  # at most as many as there were; a few don't fill every partition's file
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
