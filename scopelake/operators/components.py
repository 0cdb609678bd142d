"""Connected components of a graph of any orderable nodes, by alternating star contractions in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (high, low) after each node's greater neighbours, then its smaller ones, moved to the smallest of them."""
    both = edges.union(edges.select("low", "high"))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    large = both.join(least, "high").filter(F.col("low") > F.col("high")).select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high <> low").distinct()
    least = large.groupBy("high").agg(F.min("low").alias("least"))
    small = large.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).union(least.select("high", F.col("least").alias("low")))
    return small.filter("high <> low").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches. Rows of a round stay within the number of
    edges and nodes, and each round is written to the shared folder. Nodes without another are not listed."""
    edges = cut(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct())
    seen = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, edges = now, cut(_contracted(edges))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select("low", "low").distinct())
