"""Distances, feet, points at a distance and headings (column expressions)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..errors import UnsupportedInputError
from ..tolerance import DEFAULT, EARTH_RADIUS_METERS, EARTH_RADIUS_MILES, Tolerance
from . import intersections as ix
from .predicates import point_in_polygon, point_on_line, point_on_ray, point_on_segment, polygon_meets_polygon
from .shapes import POINT_TYPE, bind, cross, distance, edges, line, lit_, norm, pt, segments

UNITS = {"meter": EARTH_RADIUS_METERS, "m": EARTH_RADIUS_METERS, "kilometer": EARTH_RADIUS_METERS / 1000, "km": EARTH_RADIUS_METERS / 1000, "mile": EARTH_RADIUS_MILES, "mi": EARTH_RADIUS_MILES}


def euclidean(p: Column, q: Column) -> Column:
    return distance(p, q)


def manhattan(p: Column, q: Column) -> Column:
    return F.abs(p.x - q.x) + F.abs(p.y - q.y)


def manhattan_path(p: Column, q: Column) -> Column:
    """Corner path: along x first, then along y."""
    return F.array(p, pt(q.x, p.y), q)


def great_circle(p: Column, q: Column, unit: str = "meter") -> Column:
    """Haversine distance of (latitude, longitude) points in degrees."""
    lat1, lat2 = F.radians(p.x), F.radians(q.x)
    return great_circle_of(lat1, F.cos(lat1), p.y, lat2, F.cos(lat2), q.y, unit)


def great_circle_of(lat1: Column, cos1: Column, lon1: Column, lat2: Column, cos2: Column, lon2: Column, unit: str = "meter") -> Column:
    """The same of latitudes in radians, their cosines and longitudes in degrees."""
    if unit not in UNITS:
        raise UnsupportedInputError(f"unit must be one of {', '.join(UNITS)}")
    a, b = F.sin((lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    half = a * a + cos1 * cos2 * (b * b)
    # the same angle; the sine alone is as exact for less than a third of the way round, and quicker
    return 2 * UNITS[unit] * F.when(half < 0.25, F.asin(F.sqrt(half))).otherwise(F.atan2(F.sqrt(half), F.sqrt(1 - half)))


def foot_on_line(p: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    """Perpendicular foot; the point itself where it lies on the line."""
    dx, dy = t.b.x - t.a.x, t.b.y - t.a.y
    u = ((p.x - t.a.x) * dx + (p.y - t.a.y) * dy) / (dx * dx + dy * dy)
    return F.when(point_on_line(p, t, tol), p).otherwise(pt(t.a.x + u * dx, t.a.y + u * dy))


def perpendicular_ray(p: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    """Ray from the point through its foot; an error where the point lies on the line."""
    return F.when(point_on_line(p, t, tol), F.raise_error(F.lit("the point lies on the line")).cast("struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>")).otherwise(line(p, foot_on_line(p, t, tol)))


def to_line(p: Column, t: Column) -> Column:
    return F.abs(cross(t.a, t.b, p)) / distance(t.a, t.b)


def nearest_on_segment(p: Column, s: Column) -> Column:
    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    squared = dx * dx + dy * dy
    u = F.coalesce(((p.x - s.a.x) * dx + (p.y - s.a.y) * dy) / F.when(squared > 0, squared), F.lit(0.0))
    return F.when(u <= 0, s.a).when(u >= 1, s.b).otherwise(pt(s.a.x + u * dx, s.a.y + u * dy))


def to_segment(p: Column, s: Column) -> Column:
    return distance(p, nearest_on_segment(p, s))


def to_ray(p: Column, r: Column) -> Column:
    """Distance to the foot where it lies ahead, else to the origin."""
    ahead = (p.x - r.a.x) * (r.b.x - r.a.x) + (p.y - r.a.y) * (r.b.y - r.a.y) >= 0
    return F.when(ahead, to_line(p, r)).otherwise(distance(p, r.a))


def to_polyline(p: Column, seq: Column, closed: bool = False) -> Column:
    """struct(dist, nearest, index): nearest point of a polyline and the segment it lies on, first on ties."""
    parts = edges(seq) if closed else segments(seq)
    each = F.transform(parts, lambda s, i: bind(nearest_on_segment(p, s), lambda n: F.struct(distance(p, n).alias("dist"), i.alias("index"), n.alias("nearest"))))
    best = F.array_min(each)
    return F.struct(best.dist.alias("dist"), best.nearest.alias("nearest"), best["index"].alias("index"))


def to_polygon(p: Column, ring: Column) -> Column:
    """Distance to the filled polygon, 0 inside."""
    return F.when(point_in_polygon(p, ring), F.lit(0.0)).otherwise(F.array_min(F.transform(edges(ring), lambda e: to_segment(p, e))))


def polygon_to_polygon(p: Column, q: Column) -> Column:
    """Distance of filled polygons, 0 where they meet."""
    reach = lambda one, other: F.array_min(F.transform(one, lambda v: F.array_min(F.transform(edges(other), lambda e: to_segment(v, e)))))
    ways = [reach(p, q), reach(q, p)]
    return F.when(polygon_meets_polygon(p, q), F.lit(0.0)).otherwise(F.least(*ways))


def line_to_polygon(t: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """struct(dist, on_line, on_polygon): closest pair of a line and a filled polygon."""
    met = ix.with_polygon("line", t, ring, tol)
    each = F.transform(ring, lambda v: bind(foot_on_line(v, t, tol), lambda f: F.struct(distance(v, f).alias("dist"), f.alias("on_line"), v.alias("on_polygon"))))
    common = met[0]["points"][0]
    return F.when(F.size(met) > 0, F.struct(F.lit(0.0).alias("dist"), common.alias("on_line"), common.alias("on_polygon"))).otherwise(F.array_min(each))


def at_mileage(seq: Column, mileage: Column, geographic: bool = False) -> Column:
    """Point at a way along a polyline (linear in coordinates); NULL beyond its end."""
    way = great_circle if geographic else distance
    state = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        def move(d: Column) -> Column:
            here = acc["at"].isNull() & (acc["done"] + d > mileage) & (mileage >= 0)
            u = (mileage - acc["done"]) / d
            return F.struct((acc["done"] + d).alias("done"), F.when(here, pt(s.a.x + u * (s.b.x - s.a.x), s.a.y + u * (s.b.y - s.a.y))).otherwise(acc["at"]).alias("at"))

        return bind(way(s.a, s.b), move)

    return F.aggregate(segments(seq), state, step, lambda acc: acc["at"])


def length(seq: Column, closed: bool = False, geographic: bool = False) -> Column:
    way = great_circle if geographic else distance
    return F.aggregate(edges(seq) if closed else segments(seq), F.lit(0.0), lambda acc, s: acc + way(s.a, s.b))


def centroid(ring: Column) -> Column:
    """Centre of mass of a filled polygon."""
    state = F.struct(*(F.lit(0.0).alias(c) for c in ("x", "y", "w")))

    def step(acc: Column, e: Column) -> Column:
        w = e.a.x * e.b.y - e.b.x * e.a.y
        return F.struct((acc["x"] + (e.a.x + e.b.x) * w).alias("x"), (acc["y"] + (e.a.y + e.b.y) * w).alias("y"), (acc["w"] + w).alias("w"))

    return F.aggregate(edges(ring), state, step, lambda acc: pt(acc["x"] / (3 * acc["w"]), acc["y"] / (3 * acc["w"])))


def at_bearing(p: Column, degrees, way) -> Column:
    """Point at a distance; bearing 0 is +y, clockwise."""
    return pt(p.x + lit_(way) * F.sin(F.radians(lit_(degrees).cast("double"))), p.y + lit_(way) * F.cos(F.radians(lit_(degrees).cast("double"))))


@F.arrow_udf(DoubleType())
def atan2_libm(y: pa.Array, x: pa.Array) -> pa.Array:
    """atan2 of the C library, as SQL engines have it; Java's last bit differs, which puts nodes in nearly one direction in another order."""
    return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist(), strict=True)], pa.float64())


def heading(p: Column, q: Column) -> Column:
    """Bearing from p to q in [0, 360), 0 is +y, clockwise."""
    turn = F.degrees(atan2_libm(q.x - p.x, q.y - p.y))
    return F.when(turn < 0, turn + 360.0).otherwise(turn)


def heading_geographic(p: Column, q: Column) -> Column:
    """Rhumb-line bearing in [0, 360), the short way over the date line."""
    raw = F.radians(q.y) - F.radians(p.y)
    dlon = F.when(raw > math.pi, raw - 2 * math.pi).when(raw < -math.pi, raw + 2 * math.pi).otherwise(raw)
    stretch = lambda lat: F.log(F.tan(F.radians(lat) / 2 + math.pi / 4))
    return F.pmod(F.degrees(F.atan2(dlon, stretch(q.x) - stretch(p.x))) + 360.0, F.lit(360.0))


def vincenty_direct(lat: np.ndarray, lon: np.ndarray, degrees: np.ndarray, meters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of a geodesic on WGS-84 by Vincenty's direct method."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    al = np.radians(degrees)
    tu = (1 - f) * np.tan(np.radians(lat))
    cu = 1 / np.sqrt(1 + tu * tu)
    su = tu * cu
    s1 = np.arctan2(tu, np.cos(al))
    sa = cu * np.sin(al)
    c2 = 1 - sa * sa
    us = c2 * (a * a - b * b) / (b * b)
    big_a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
    big_b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
    sigma = meters / (b * big_a)
    for _ in range(30):
        cm = np.cos(2 * s1 + sigma)
        ss, cs = np.sin(sigma), np.cos(sigma)
        more = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        sigma = meters / (b * big_a) + more
    cm, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    out = np.arctan2(su * cs + cu * ss * np.cos(al), (1 - f) * np.hypot(sa, su * ss - cu * cs * np.cos(al)))
    lam = np.arctan2(ss * np.sin(al), cu * cs - su * ss * np.cos(al))
    c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
    turn = lam - (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    return np.degrees(out), (lon + np.degrees(turn) + 540) % 360 - 180


@F.pandas_udf(POINT_TYPE)
def at_bearing_geographic(lat: pd.Series, lon: pd.Series, degrees: pd.Series, meters: pd.Series) -> pd.DataFrame:
    """Geodesic destination on WGS-84; no built-in function knows the ellipsoid."""
    x, y = vincenty_direct(*(np.asarray(c, float) for c in (lat, lon, degrees, meters)))
    return pd.DataFrame({"x": x, "y": y})


on_segment = point_on_segment
on_ray = point_on_ray
magnitude = norm
