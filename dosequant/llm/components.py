"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosequant.llm.storage import written
from dosequant.operators.skew import join_apart


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the greater neighbours of each node to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    near = join_apart(both, least, "u", "large").where("v > u")
    return near.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_apart(down, least, "u", "small").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (`u`, `v`, longs); root is the least.

    The table of links never grows: each round writes one of at most as many rows,
    and ends when it is what it was.
    """
    edges = written(links.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = written(_small_star(_large_star(edges)), "links")
