"""Scalar predicates on points, segments, rays, lines and polygons (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tolerance import DEFAULT, Tolerance
from . import intersections as ix
from .shapes import cross, distance, edges, segments


def same_point(p: Column, q: Column, tol: Tolerance = DEFAULT) -> Column:
    """Both coordinates differ by less than the point tolerance."""
    return (F.abs(p.x - q.x) < tol.point) & (F.abs(p.y - q.y) < tol.point)


def clockwise(p: Column, q: Column, r: Column, tol: Tolerance = DEFAULT) -> Column:
    """TRUE for a right turn, FALSE for a left turn, NULL where collinear or two points coincide."""
    turn = cross(p, q, r)
    flat = same_point(p, q, tol) | same_point(q, r, tol) | same_point(p, r, tol) | (F.abs(turn) <= tol.collinear)
    return F.when(~flat, turn < 0)


def same_segment(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return (same_point(s.a, t.a, tol) & same_point(s.b, t.b, tol)) | (same_point(s.a, t.b, tol) & same_point(s.b, t.a, tol))


def parallel(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    """Directions agree up to the slope tolerance; a segment without length is an error."""
    turn = (s.b.x - s.a.x) * (t.b.y - t.a.y) - (s.b.y - s.a.y) * (t.b.x - t.a.x)
    size = distance(s.a, s.b) * distance(t.a, t.b)
    return F.when(size == 0, F.raise_error(F.lit("a segment without length has no direction"))).otherwise(F.abs(turn) <= tol.slope * size)


def point_on_line(p: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return F.when(same_point(t.a, t.b, tol), F.raise_error(F.lit("a line needs two points"))).otherwise(clockwise(t.a, t.b, p, tol).isNull())


def point_on_segment(p: Column, s: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
    """Collinear, and the ways to both ends add up to the segment."""
    near = F.abs(distance(p, s.a) + distance(p, s.b) - distance(s.a, s.b)) <= tol.delta
    on = clockwise(s.a, s.b, p, tol).isNull() & near
    return on & ~same_point(p, s.a, tol) & ~same_point(p, s.b, tol) if interior else on


def point_on_ray(p: Column, r: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
    ahead = point_on_segment(p, r, False, tol) | (distance(p, r.b) < distance(p, r.a))
    on = clockwise(r.a, r.b, p, tol).isNull() & ahead
    return on & ~same_point(p, r.a, tol) if interior else on


def collinear_segments(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return parallel(s, t, tol) & (point_on_line(s.a, t, tol) | point_on_line(s.b, t, tol))


def overlapping_segments(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    """Parallel with a common point; one may lie inside the other."""
    ends = [point_on_segment(p, o, False, tol) for p, o in ((s.a, t), (s.b, t), (t.a, s), (t.b, s))]
    return parallel(s, t, tol) & (ends[0] | ends[1] | ends[2] | ends[3])


def point_on_ring(p: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """On the boundary of the polygon."""
    return F.exists(edges(ring), lambda e: point_on_segment(p, e, False, tol))


def point_in_polygon(p: Column, ring: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
    """Even-odd rule; the boundary is half-open unless only the interior is asked for."""

    def crossed(acc: Column, e: Column) -> Column:
        spans = (e.a.y > p.y) != (e.b.y > p.y)
        at = e.a.x + (p.y - e.a.y) * (e.b.x - e.a.x) / F.when(spans, e.b.y - e.a.y)
        return acc != F.coalesce(spans & (p.x < at), F.lit(False))

    inside = F.aggregate(edges(ring), F.lit(False), crossed)
    return inside & ~point_on_ring(p, ring, tol) if interior else inside


def simple_polygon(ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """No two edges that are not neighbours meet."""
    numbered = F.transform(edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    n = F.size(ring)

    def clash(s: Column) -> Column:
        return F.exists(numbered, lambda t: (t.i > s.i + 1) & ~((s.i == 0) & (t.i == n - 1)) & ix.crosses("seg", s.e, "seg", t.e, False, tol))

    return (n >= 3) & ~F.exists(numbered, clash)


def _pair(kind1: str, kind2: str):
    def test(s: Column, t: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
        return ix.crosses(kind1, s, kind2, t, interior, tol)

    test.__name__ = f"{kind1}_meets_{kind2}"
    test.__doc__ = f"Whether a {kind1} meets a {kind2}; interior: elsewhere than at end points only."
    return test


line_meets_line = _pair("line", "line")
line_meets_seg = _pair("line", "seg")
line_meets_ray = _pair("line", "ray")
seg_meets_line = _pair("seg", "line")
seg_meets_seg = _pair("seg", "seg")
seg_meets_ray = _pair("seg", "ray")
ray_meets_line = _pair("ray", "line")
ray_meets_seg = _pair("ray", "seg")
ray_meets_ray = _pair("ray", "ray")


def _with_polygon(kind: str):
    def test(s: Column, ring: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
        parts = ix.with_polygon(kind, s, ring, tol)
        return F.exists(parts, lambda part: part.interior) if interior else F.size(parts) > 0

    test.__name__ = f"{kind}_meets_polygon"
    test.__doc__ = f"Whether a {kind} meets a filled polygon; interior: with a part inside it."
    return test


line_meets_polygon = _with_polygon("line")
seg_meets_polygon = _with_polygon("seg")
ray_meets_polygon = _with_polygon("ray")


def polygon_meets_polygon(p: Column, q: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
    """Filled polygons with a common point; interior: edges that cross, or a vertex strictly inside."""
    within = F.exists(p, lambda v: point_in_polygon(v, q, True, tol)) | F.exists(q, lambda v: point_in_polygon(v, p, True, tol))
    touch = F.exists(edges(p), lambda e: F.exists(edges(q), lambda f: ix.crosses("seg", e, "seg", f, interior, tol)))
    through = lambda one, other: F.exists(edges(one), lambda e: F.exists(ix.with_polygon("seg", e, other, tol), lambda part: part.interior))
    # edges of each on the other's boundary only: the same polygon, or two that touch
    border = lambda one, other: F.forall(edges(one), lambda e: point_on_ring(e.a, other, tol) & point_on_ring(F.struct(((e.a.x + e.b.x) / 2).alias("x"), ((e.a.y + e.b.y) / 2).alias("y")), other, tol))
    return within | through(p, q) | through(q, p) | (border(p, q) & border(q, p)) if interior else within | touch


def box_meets_segment(s: Column, box: Column) -> Column:
    """Exact test of a segment against a box struct (x_min, x_max, y_min, y_max), cheap rejects first."""
    inside = lambda p: p.x.between(box.x_min, box.x_max) & p.y.between(box.y_min, box.y_max)
    apart = (F.greatest(s.a.x, s.b.x) < box.x_min) | (F.least(s.a.x, s.b.x) > box.x_max) | (F.greatest(s.a.y, s.b.y) < box.y_min) | (F.least(s.a.y, s.b.y) > box.y_max)
    corner = lambda x, y: F.signum((s.b.x - s.a.x) * (y - s.a.y) - (s.b.y - s.a.y) * (x - s.a.x))
    sides = [corner(x, y) for x in (box.x_min, box.x_max) for y in (box.y_min, box.y_max)]
    return inside(s.a) | inside(s.b) | (~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))


def intervals_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed intervals with a common point; the ends of each may come in either order."""
    return F.greatest(F.least(lo1, hi1), F.least(lo2, hi2)) <= F.least(F.greatest(lo1, hi1), F.greatest(lo2, hi2))


def polyline_meets_polygon(seq: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    return F.exists(segments(seq), lambda s: seg_meets_polygon(s, ring, False, tol))
