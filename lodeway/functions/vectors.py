"""Vectors, projections, areas, orientation, circles and colours (column expressions)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tolerance import DEFAULT, EARTH_RADIUS_METERS, Tolerance
from .distances import at_bearing, length, vincenty_direct
from .shapes import POLY_TYPE, bind, cross, distance, edges, lit_, pt, unit


def polar(norm_, degrees) -> Column:
    return F.struct(lit_(norm_).cast("double").alias("norm"), lit_(degrees).cast("double").alias("deg"))


def polar_to_xy(v: Column) -> Column:
    turn = F.radians(F.pmod(v["deg"], F.lit(360.0)))
    return pt(v["norm"] * F.sin(turn), v["norm"] * F.cos(turn))


def xy_to_polar(v: Column, tol: Tolerance = DEFAULT) -> Column:
    """Norm and bearing; the bearing of a vector with |y| within the tolerance is that of a horizontal one."""
    return bind(v, lambda w: _polar(w, tol))


def _polar(v: Column, tol: Tolerance) -> Column:
    turn = F.degrees(F.atan2(v.x, v.y))
    level = F.abs(v.y) <= tol.vertical
    return F.struct(
        F.sqrt(v.x * v.x + v.y * v.y).alias("norm"),
        F.when(level, F.when(v.x >= 0, F.lit(90.0)).otherwise(F.lit(270.0))).otherwise(F.when(turn < 0, turn + 360.0).otherwise(turn)).alias("deg"),
    )


def polar_add(v: Column, w: Column) -> Column:
    a, b = polar_to_xy(v), polar_to_xy(w)
    return xy_to_polar(pt(a.x + b.x, a.y + b.y))


def polar_subtract(v: Column, w: Column) -> Column:
    a, b = polar_to_xy(v), polar_to_xy(w)
    return xy_to_polar(pt(a.x - b.x, a.y - b.y))


def random_vector(seed: int, key: Column, norm_: float = 1.0) -> Column:
    """A vector of that norm whose bearing depends on seed and key only."""
    return polar_to_xy(polar(norm_, unit(seed, key, F.lit("bearing")) * 360.0))


def mercator_to_geographic(p: Column) -> Column:
    """x is northing and y easting in metres."""
    return pt(F.degrees(2 * F.atan(F.exp(p.x / EARTH_RADIUS_METERS)) - math.pi / 2), F.degrees(p.y / EARTH_RADIUS_METERS))


def geographic_to_mercator(p: Column) -> Column:
    return pt(F.log(F.tan(math.pi / 4 + F.radians(p.x) / 2)) * EARTH_RADIUS_METERS, F.radians(p.y) * EARTH_RADIUS_METERS)


def polygon_mercator_to_geographic(ring: Column) -> Column:
    return F.transform(ring, mercator_to_geographic)


def polygon_geographic_to_mercator(ring: Column) -> Column:
    return F.transform(ring, geographic_to_mercator)


def triangle_area_by_sides(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    return F.abs(cross(p, q, r)) / 2


def signed_area(ring: Column) -> Column:
    """Positive where the vertices run counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return length(ring, closed=True)


def is_clockwise(ring: Column) -> Column:
    return signed_area(ring) < 0


def to_clockwise(ring: Column) -> Column:
    return F.when(is_clockwise(ring), ring).otherwise(F.reverse(ring))


def to_counter_clockwise(ring: Column) -> Column:
    return F.when(is_clockwise(ring), F.reverse(ring)).otherwise(ring)


def circle(center: Column, radius, sides: int = 30) -> Column:
    """Regular polygon around a centre, clockwise from +y."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: at_bearing(center, i * (360.0 / sides), lit_(radius).cast("double")))


@F.pandas_udf(POLY_TYPE)
def circle_geographic(lat: pd.Series, lon: pd.Series, meters: pd.Series, sides: pd.Series) -> pd.Series:
    """Polygon of geodesic destinations around a centre."""
    out = []
    for a, o, r, n in zip(lat, lon, meters, sides, strict=True):
        x, y = vincenty_direct(np.full(n, a), np.full(n, o), np.arange(n) * 360.0 / n, np.full(n, float(r)))
        out.append([{"x": p, "y": q} for p, q in zip(x, y, strict=True)])
    return pd.Series(out)


def area_geographic(ring: Column) -> Column:
    """Area in square metres on the sphere of equal surface to WGS-84.

    Latitudes are taken to authalic ones; edges follow parallels' chords, so long
    edges away from the equator deviate from geodesics.
    """
    e2 = 0.0066943799901413165
    e = math.sqrt(e2)
    qp = 1 + (1 - e2) / (2 * e) * math.log((1 + e) / (1 - e))
    radius = EARTH_RADIUS_METERS * math.sqrt(qp / 2)

    def authalic(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        return q / qp

    total = F.aggregate(edges(ring), F.lit(0.0), lambda acc, g: acc + F.radians(g.b.y - g.a.y) * (2 + authalic(g.a.x) + authalic(g.b.x)))
    return F.abs(total) * (radius * radius / 2)


def hex_to_rgb(colour: Column) -> Column:
    """struct(r, g, b) of #rgb or #rrggbb; a short form gives one digit for each."""
    h = F.ltrim(colour, F.lit("#"))
    w = (F.length(h) / 3).cast("int")
    part = lambda i: F.conv(F.substring(h, i * w + 1, w), 16, 10).cast("int")
    return F.struct(part(F.lit(0)).alias("r"), part(F.lit(1)).alias("g"), part(F.lit(2)).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def complement(colour: Column) -> Column:
    """Each channel subtracted from the sum of the largest and the smallest."""
    c = hex_to_rgb(colour)
    k = F.greatest(c["r"], c["g"], c["b"]) + F.least(c["r"], c["g"], c["b"])
    return rgb_to_hex(k - c["r"], k - c["g"], k - c["b"])


def text_colour(colour: Column) -> Column:
    """'black' on light colours, 'white' on dark ones: luma of 192 or more is light."""
    c = hex_to_rgb(colour)
    return F.when(0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"] >= 192, F.lit("black")).otherwise(F.lit("white"))


def random_colour(seed: int, key: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.floor(unit(seed, key, F.lit("colour")) * 16777216).cast("long"))), 6, "0"))


def speed(p: Column, q: Column, seconds: Column) -> Column:
    return distance(p, q) / seconds
