"""Bounding boxes and polygon overlays as aggregations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import EmptyError
from ..functions.shapes import POLY
from ..solvers import overlay


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Column `out`: sum of `value` over all rows before, in that order.

    Ranges of rows are written once and summed apart; each starts at the total of
    the ranges before it, of which there is one row each.
    """
    at = F.col("_at")
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright(at, 33))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(F.broadcast(totals), "_part")
    return rows.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0.0))).drop("_at", "_part", "_before")


def points_of(df: DataFrame, *, point: str | None = None, arc: str | None = None, ring: str | None = None, rings: str | None = None) -> DataFrame:
    """Rows (x, y) of one shape column."""
    if point:
        return df.select(F.col(f"{point}.x").alias("x"), F.col(f"{point}.y").alias("y"))
    if arc:
        p = F.explode(F.array(F.col(f"{arc}.a"), F.col(f"{arc}.b")))
    elif ring:
        p = F.explode(ring)
    elif rings:
        p = F.explode(F.flatten(rings))
    else:
        raise EmptyError("name a shape column")
    return df.select(p.alias("p")).select("p.x", "p.y")


def bounding_box(*points: DataFrame, box: tuple | None = None, pad: float = 0.1, swap: bool = False, group: list[str] | None = None) -> DataFrame:
    """x_min, x_max, y_min, y_max over all points and an existing box, padded by a share of the range.

    Map tasks keep four numbers for each group, so one small row each is shuffled.
    """
    if not points:
        raise EmptyError("no points given")
    every = points[0]
    for more in points[1:]:
        every = every.unionByName(more)
    out = every.groupBy(*(group or [])).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if box:
        low = lambda c, v: F.least(F.col(c), F.lit(v)) if v is not None else F.col(c)
        high = lambda c, v: F.greatest(F.col(c), F.lit(v)) if v is not None else F.col(c)
        out = out.withColumns({"x0": low("x0", box[0]), "x1": high("x1", box[1]), "y0": low("y0", box[2]), "y1": high("y1", box[3])})
    dx, dy = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    cols = {"x_min": F.col("x0") - dx, "x_max": F.col("x1") + dx, "y_min": F.col("y0") - dy, "y_max": F.col("y1") + dy}
    if swap:
        cols = {"x_min": cols["y_min"], "x_max": cols["y_max"], "y_min": cols["x_min"], "y_max": cols["x_max"]}
    return out.select(*(group or []), *(c.alias(k) for k, c in cols.items()))


def bounding_box_3d(points: DataFrame, pad: float = 0.1, group: list[str] | None = None) -> DataFrame:
    """The same over x, y and z."""
    aggs = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    out = points.groupBy(*(group or [])).agg(*aggs)
    span = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * pad
    return out.select(*(group or []), *(e for c in "xyz" for e in ((F.col(f"{c}_lo") - span(c)).alias(f"{c}_min"), (F.col(f"{c}_hi") + span(c)).alias(f"{c}_max"))))


def _frame(group: int, rings: list) -> pd.DataFrame:
    rows = [(group, i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)]
    return pd.DataFrame(rows, columns=["group_id", "part", "poly"], dtype=object)


def _rings(op, sort: str | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if sort:
            pdf = pdf.sort_values(sort, kind="stable")
        rings = [[(p["x"], p["y"]) for p in r] for r in pdf["poly"]]
        out = op(rings)
        return _frame(pdf["group_id"].iloc[0], out)

    return run


def _overlay(df: DataFrame, op, group: str, ring: str, key: str | None) -> DataFrame:
    rows = df.select(F.col(group).cast("long").alias("group_id"), F.col(ring).alias("poly"), *([F.col(key).alias("_key")] if key else []))
    return rows.groupBy("group_id").applyInPandas(_rings(op, "_key" if key else None), f"group_id long, part int, poly {POLY}")


def polygon_union(df: DataFrame, group: str, ring: str = "poly", key: str | None = None) -> DataFrame:
    """Outer rings of the union of each group's polygons, one row for each part."""
    return _overlay(df, overlay.union, group, ring, key)


def polygon_intersection(df: DataFrame, group: str, ring: str = "poly", key: str | None = None) -> DataFrame:
    """What all polygons of a group have in common."""
    return _overlay(df, overlay.intersection, group, ring, key)


def polygon_difference(df: DataFrame, minus: DataFrame, group: str, ring: str = "poly") -> DataFrame:
    """Union of a group's polygons less the union of the polygons of `minus` under the same group."""
    rows = df.select(F.col(group).cast("long").alias("group_id"), F.col(ring).alias("poly"), F.lit(False).alias("cut")).unionByName(minus.select(F.col(group).cast("long").alias("group_id"), F.col(ring).alias("poly"), F.lit(True).alias("cut")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        take = lambda flag: [[(p["x"], p["y"]) for p in r] for r in pdf.loc[pdf["cut"] == flag, "poly"]]
        out = overlay.difference(take(False), take(True))
        return _frame(pdf["group_id"].iloc[0], out)

    return rows.groupBy("group_id").applyInPandas(run, f"group_id long, part int, poly {POLY}")


def figure_size(x_min: float, x_max: float, y_min: float, y_max: float, width: float | None = None, height: float | None = None, side: float = 5.0) -> tuple[float, float]:
    """Width and height of a figure in the ratio of a box; without either the longer side is `side`."""
    w, h = max(x_max - x_min, 1e-9), max(y_max - y_min, 1e-9)
    if width is not None and height is not None:
        return width, height
    if width is not None:
        return width, width * h / w
    if height is not None:
        return height * w / h, height
    return (side, side * h / w) if w >= h else (side * w / h, side)
