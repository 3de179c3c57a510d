"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import cut


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")).distinct())
    clash = roles.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
    return clash.isEmpty()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) for every node of an edge.

    Each round is two joins on node keys; edges and labels stay distributed and
    every round is written to the checkpoint folder.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    e = cut(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    for _ in range(rounds):
        if _is_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
