"""Shapes as Spark columns: points, lines given by two points, and vertex arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

POINT = "struct<x:double,y:double>"
POLY = f"array<{POINT}>"
POINT_TYPE = StructType().add("x", DoubleType()).add("y", DoubleType())
POLY_TYPE = ArrayType(POINT_TYPE)


def lit_(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def pt(x, y) -> Column:
    """A point; for geographic points x is the latitude and y the longitude."""
    return F.struct(lit_(x).cast("double").alias("x"), lit_(y).cast("double").alias("y"))


def line(a: Column, b: Column) -> Column:
    """Two points; the function that takes it reads it as line, segment or ray from a."""
    return F.struct(a.alias("a"), b.alias("b"))


def poly(points: list[tuple[float, float]]) -> Column:
    """A constant polygon or polyline; polygons do not repeat their first vertex."""
    return F.array(*(pt(float(x), float(y)) for x, y in points))


def segments(seq: Column) -> Column:
    """The segments of a polyline in order."""
    n = F.size(seq)
    return F.filter(F.zip_with(F.slice(seq, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(seq, F.lit(2), F.greatest(n - 1, F.lit(0))), line), lambda s: s.a.isNotNull())


def edges(ring: Column) -> Column:
    """The edges of a polygon, the closing one last."""
    n = F.size(ring)
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), line)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row, whatever the optimizer joins."""
    return F.transform(F.array(value), body)[0]


def cross(o: Column, p: Column, q: Column) -> Column:
    """Cross product of op and oq: positive when q lies left of op."""
    return (p.x - o.x) * (q.y - o.y) - (p.y - o.y) * (q.x - o.x)


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(p: Column, q: Column) -> Column:
    return norm(q.x - p.x, q.y - p.y)


def unit(seed: int, *keys) -> Column:
    """Uniform value in [0, 1) from a hash of seed and keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)
