"""Connected components of an undirected edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Each step is one grouped minimum,
combined before its shuffle, and one join; the edge table is written between
steps, so that lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(pairs: DataFrame) -> DataFrame:
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    grown = pairs.join(_lowest(pairs), pairs.a == F.col("u")).where("b > a")
    return grown.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    moved = down.join(low, down.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root), root being the component's smallest node.

    Nodes without an edge to another node don't appear. Loops, repeated edges
    and null ends are allowed and ignored.
    """
    now = scratch.save(edges.where("a <> b").select("a", "b"))
    sums = F.expr("count(*)").alias("n"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)").alias("x")
    before = None
    while True:
        after = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now, mark = after, tuple(after.agg(*sums).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
