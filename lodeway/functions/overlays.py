"""Polygon overlay and triangulation of one row's polygons (Arrow batches; no built-in function does these)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..solvers import overlay
from .shapes import POLY_TYPE

PARTS = ArrayType(StructType().add("type", StringType()).add("points", POLY_TYPE))


def _ring(points) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in points]


def _points(ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def common_parts(p: overlay.Ring, q: overlay.Ring, near: float = 0.01) -> list[tuple[str, list]]:
    """Polygons that two polygons share, and where they only touch, the segments and points."""
    areas = overlay.intersection([p, q])
    if areas:
        return [("Polygon", r) for r in areas]
    segments, points = [], []
    for a, b in zip(p, p[1:] + p[:1], strict=True):
        for c, d in zip(q, q[1:] + q[:1], strict=True):
            on = sorted({v for v, (s, t) in ((a, (c, d)), (b, (c, d)), (c, (a, b)), (d, (a, b))) if abs(math.dist(v, s) + math.dist(v, t) - math.dist(s, t)) <= 1e-7})
            if len(on) > 1 and math.dist(on[0], on[-1]) > near:
                segments.append((on[0], on[-1]))
            else:
                points += on[:1]
    lone = [v for v in dict.fromkeys(points) if not any(abs(math.dist(v, s) + math.dist(v, t) - math.dist(s, t)) <= 1e-7 for s, t in segments)]
    return [("Segment", list(s)) for s in dict.fromkeys(segments)] + [("Point", [v]) for v in lone]


@F.pandas_udf(PARTS)
def polygon_polygon(p: pd.Series, q: pd.Series) -> pd.Series:
    """Array of struct(type, points): Polygon, Segment or Point parts of an intersection; empty where none."""
    return pd.Series([[{"type": k, "points": _points(r)} for k, r in common_parts(_ring(a), _ring(b))] for a, b in zip(p, q, strict=True)])


@F.pandas_udf(ArrayType(POLY_TYPE))
def triangulate(p: pd.Series) -> pd.Series:
    """Ear clipping from the first vertex on."""
    return pd.Series([[_points(t) for t in overlay.triangles(_ring(r))] for r in p])
