"""Orders of nodes by distance and bearing, and range queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import euclidean, heading
from ..functions.shapes import pt


def _windowed(df: DataFrame, group: list[str], *order) -> Window:
    return (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)


def by_distance(nodes: DataFrame, ref, key: str = "node_id", loc: str = "loc", group: list[str] | None = None) -> DataFrame:
    """Columns dist and seq: nodes in the order of distance to ref (a column), ties by key."""
    out = nodes.withColumn("dist", euclidean(F.col(loc), ref))
    return out.withColumn("seq", F.row_number().over(_windowed(out, group or [], "dist", key)))


def by_bearing(nodes: DataFrame, ref, key: str = "node_id", loc: str = "loc", clockwise: bool = True, start: float = 0.0, group: list[str] | None = None, at_ref: float | None = None) -> DataFrame:
    """Columns deg and seq: nodes around ref by bearing from `start`; ties by distance, then key.

    Nodes at ref have no bearing and come last, or count as at the bearing `at_ref`.
    """
    dist = euclidean(F.col(loc), ref)
    # nothing is added to what is in [0, 360) already: that would round bearings apart to ties
    turn = F.pmod((heading(ref, F.col(loc)) - F.lit(start)) * (1 if clockwise else -1), F.lit(360.0))
    out = nodes.withColumns({"_d": dist, "deg": F.when(dist > 0, turn).otherwise(F.lit(at_ref).cast("double"))})
    return out.withColumn("seq", F.row_number().over(_windowed(out, group or [], F.col("deg").isNull(), "deg", "_d", key))).drop("_d")


def center(nodes: DataFrame, loc: str = "loc") -> DataFrame:
    """One row (ref): the mean location, the default centre of a sweep."""
    return nodes.agg(F.avg(f"{loc}.x").alias("x"), F.avg(f"{loc}.y").alias("y")).select(pt(F.col("x"), F.col("y")).alias("ref"))


def isochrone(nodes: DataFrame, ref, radius: float, key: str = "node_id", loc: str = "loc") -> DataFrame:
    """Nodes within radius of ref, with dist; a filter without a shuffle."""
    return nodes.withColumn("dist", euclidean(F.col(loc), ref)).where(F.col("dist") <= radius)


def nearest_node(nodes: DataFrame, ref, key: str = "node_id", loc: str = "loc") -> DataFrame:
    """One row: the nearest node, ties by key."""
    dist = euclidean(F.col(loc), ref)
    return nodes.agg(F.min_by(key, F.struct(dist.alias("d"), F.col(key))).alias(key), F.min(dist).alias("dist"))
