"""Connected components by alternating star contractions, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stats(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of every node move to the smallest node of its neighbourhood.

    large: neighbours greater than the node move; else the smaller ones and the node itself do.
    """
    if large:
        sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = sym.join(low, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    edges has the long columns u and v; loops and repeated rows are harmless, an empty table gives an empty one.
    Rows per round stay within the number of edges and nodes: a star of any size contracts to a star. The edges of
    each round are checkpointed in the shared folder, so the plan does not grow and lost executors cost one round.
    """
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    seen = _stats(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = cut(_star(_star(edges, True), False))
        now = _stats(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
