"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _round(edges: DataFrame) -> DataFrame:
    """edges (u > v). Large-star hooks larger neighbours to the least one, small-star the smaller ones and the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(low, "u")
    small = near.select("u", F.col("m").alias("v")).union(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node. ``edges``: u, v of one orderable type.

    Every round is checkpointed, so lineage stays short and a lost executor costs one round at most.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now[0] == 0 or now == seen:
            break
        seen, edges = now, cut(_round(edges))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
