"""Connected components of an edge table by alternating star contraction.

Every step is a group-by with partial aggregation and a join; a node's neighbours are never
gathered in one record, so a node with very many links is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour to the smallest of the closed neighbourhood.
    Small star: link the node and its smaller neighbours to that smallest one."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (a, b bigint).

    Each round is written to the shared folder, which cuts the lineage.  Raises if the rounds
    do not suffice (they grow with the logarithm of the longest path)."""
    now = stage(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = None
    for _ in range(max_rounds):
        now = stage(_star(_star(now, True), False))
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (got["n"], got["h"]) == sums:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        sums = (got["n"], got["h"])
    raise RuntimeError("connected components did not settle")
