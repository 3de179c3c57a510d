"""Intersections as structs: status, points, type and whether they are interior.

A shape runs along the line through its two points, over the parameter range
[0, 1] (segment), [0, oo) (ray) or (-oo, oo) (line).  Collinear shapes meet
where their ranges do; others where the two lines cross, if that point lies in
both ranges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tolerance import DEFAULT, Tolerance
from .shapes import bind, cross, distance, edges, line, pt

RESULT = "struct<status:string,points:array<struct<x:double,y:double>>,type:string,interior:boolean>"
RANGE = {"seg": (0.0, 1.0), "ray": (0.0, float("inf")), "line": (float("-inf"), float("inf"))}
NAME = {"seg": "Segment", "ray": "Ray", "line": "Line"}


def _result(status: str, points: list[Column] | Column | None, kind: str | None, interior: bool | Column | None) -> Column:
    array = F.lit(None) if points is None else points if isinstance(points, Column) else F.array(*points)
    flag = interior if isinstance(interior, Column) else F.lit(interior)
    return F.struct(F.lit(status).alias("status"), array.cast("array<struct<x:double,y:double>>").alias("points"), F.lit(kind).cast("string").alias("type"), flag.cast("boolean").alias("interior"))


def _same(p: Column, q: Column, tol: Tolerance) -> Column:
    return (F.abs(p.x - q.x) < tol.point) & (F.abs(p.y - q.y) < tol.point)


def _ends(kind: str, s: Column) -> list[Column]:
    return {"seg": [s.a, s.b], "ray": [s.a], "line": []}[kind]


def intersect(kind1: str, s: Column, kind2: str, t: Column, tol: Tolerance = DEFAULT) -> Column:
    """Intersection of two shapes of the kinds 'seg', 'ray' and 'line'."""
    dx, dy, ex, ey = s.b.x - s.a.x, s.b.y - s.a.y, t.b.x - t.a.x, t.b.y - t.a.y
    det = dx * ey - dy * ex
    open_ = F.when(F.abs(det) > tol.collinear, det)
    u = ((t.a.x - s.a.x) * ey - (t.a.y - s.a.y) * ex) / open_
    v = ((t.a.x - s.a.x) * dy - (t.a.y - s.a.y) * dx) / open_
    values = {"s": s, "t": t, "dx": dx, "dy": dy, "length": distance(s.a, s.b), "length2": distance(t.a, t.b), "flat": F.abs(det) <= tol.collinear, "off": F.abs(cross(s.a, s.b, t.a)), "u": u, "v": v}
    # bound once: the ladder below names each of them many times
    return bind(F.struct(*(c.alias(n) for n, c in values.items())), lambda o: _ladder(kind1, kind2, o, tol))


def _ladder(kind1: str, kind2: str, o: Column, tol: Tolerance) -> Column:
    s, t, dx, dy, length, flat, u, v = (o[n] for n in ("s", "t", "dx", "dy", "length", "flat", "u", "v"))
    together = flat & (o["off"] <= tol.collinear)

    # crossing point
    at = pt(s.a.x + u * dx, s.a.y + u * dy)
    slack1, slack2 = tol.point / F.when(length > 0, length), tol.point / F.when(o["length2"] > 0, o["length2"])

    def within(value: Column, kind: str, slack: Column) -> Column:
        low, high = RANGE[kind]
        test = F.lit(True)
        if low == 0.0:
            test = test & (value >= -slack)
        if high == 1.0:
            test = test & (value <= 1 + slack)
        return test

    border = F.lit(False)
    for end in [*_ends(kind1, s), *_ends(kind2, t)]:
        border = border | _same(at, end, tol)
    crossing = F.when(within(u, kind1, slack1) & within(v, kind2, slack2), _result("Cross", [at], "Point", ~border)).otherwise(_result("NoCross", None, None, None))

    # collinear: range of the second shape on the scale of the first
    on = lambda p: ((p.x - s.a.x) * dx + (p.y - s.a.y) * dy) / F.when(length > 0, length * length)
    p, q = on(t.a), on(t.b)
    forward = q >= p
    inf = F.lit(float("inf"))
    if kind2 == "seg":
        low2, high2 = F.least(p, q), F.greatest(p, q)
    elif kind2 == "ray":
        low2, high2 = F.when(forward, p).otherwise(-inf), F.when(forward, inf).otherwise(p)
    else:
        low2, high2 = -inf, inf
    low1, high1 = (F.lit(x) for x in RANGE[kind1])
    first = low1 >= low2 - slack1  # the first shape's low end lies in the second
    first_inside = first & (high1 <= high2 + slack1)
    second_inside = (low2 >= low1 - slack1) & (high2 <= high1 + slack1)
    low, high = F.greatest(low1, low2), F.least(high1, high2)
    here = lambda r: pt(s.a.x + r * dx, s.a.y + r * dy)
    point = F.abs(high - low) <= slack1
    mixed = F.when(first, F.array(here(low1), here(high2))).otherwise(F.array(here(high1), here(low2)))
    overlap = (
        F.when(low > high + slack1, _result("Collinear", None, None, None))
        .when(point & low.between(-1e300, 1e300), _result("Collinear", [here(low)], "Point", False))
        .when(first_inside, _result("Collinear", [s.a, s.b], NAME[kind1], True))
        .when(second_inside, _result("Collinear", [t.a, t.b], NAME[kind2], True))
        .otherwise(_result("Collinear", mixed, "Segment", True))
    )
    return F.when(together, overlap).when(flat, _result("NoCross", None, None, None)).otherwise(crossing)


def crosses(kind1: str, s: Column, kind2: str, t: Column, interior: bool = False, tol: Tolerance = DEFAULT) -> Column:
    found = intersect(kind1, s, kind2, t, tol)
    met = found["points"].isNotNull()
    return met & F.coalesce(found["interior"], F.lit(False)) if interior else met


def line_line(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("line", s, "line", t, tol)


def line_seg(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("line", s, "seg", t, tol)


def line_ray(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("line", s, "ray", t, tol)


def seg_line(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("seg", s, "line", t, tol)


def seg_seg(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("seg", s, "seg", t, tol)


def seg_ray(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("seg", s, "ray", t, tol)


def ray_line(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("ray", s, "line", t, tol)


def ray_seg(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("ray", s, "seg", t, tol)


def ray_ray(s: Column, t: Column, tol: Tolerance = DEFAULT) -> Column:
    return intersect("ray", s, "ray", t, tol)


def inside_ranges(kind: str, s: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """Ranges array<struct<lo,hi>> of a shape's parameter that lie in the filled polygon.

    The crossings with the edges cut the shape; a piece belongs to the polygon
    when its middle does.  Pieces that touch are joined.
    """
    from .predicates import point_in_polygon, point_on_ring

    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    squared = dx * dx + dy * dy
    on = lambda p: ((p.x - s.a.x) * dx + (p.y - s.a.y) * dy) / F.when(squared > 0, squared)
    at = lambda r: pt(s.a.x + r * dx, s.a.y + r * dy)
    low, high = RANGE[kind]
    ends = [F.lit(x) for x in (low, high) if abs(x) < 2]
    none = F.array().cast("array<double>")

    def cuts_of(e: Column) -> Column:
        ex, ey = e.b.x - e.a.x, e.b.y - e.a.y
        det = dx * ey - dy * ex
        values = F.struct(det.alias("det"), ((e.a.x - s.a.x) * ey - (e.a.y - s.a.y) * ex).alias("u"), ((e.a.x - s.a.x) * dy - (e.a.y - s.a.y) * dx).alias("v"), F.abs(cross(s.a, s.b, e.a)).alias("off"), e.alias("e"))

        def params(o: Column) -> Column:
            u, v = o["u"] / o["det"], o["v"] / o["det"]
            slack, over = tol.point / F.sqrt(squared), tol.point / distance(o["e"].a, o["e"].b)
            near = (v >= -over) & (v <= 1 + over)
            if low == 0.0:
                near = near & (u >= -slack)
            if high == 1.0:
                near = near & (u <= 1 + slack)
            return F.when(F.abs(o["det"]) <= tol.collinear, F.when(o["off"] <= tol.collinear, F.array(on(o["e"].a), on(o["e"].b))).otherwise(none)).when(near, F.array(u)).otherwise(none)

        return bind(values, params)

    met = F.filter(F.flatten(F.transform(edges(ring), cuts_of)), lambda r: r.isNotNull())
    clipped = F.transform(met, lambda r: F.greatest(F.lit(low), F.least(F.lit(high), r)))
    cuts = F.array_sort(F.array_distinct(F.concat(clipped, F.array(*ends)) if ends else clipped))
    n = F.size(cuts)

    def ranges(c: Column) -> Column:
        pieces = F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
        held = F.filter(pieces, lambda w: bind(at((w.lo + w.hi) / 2), lambda m: point_in_polygon(m, ring, False, tol) | point_on_ring(m, ring, tol)))
        return bind(held, lambda h: whole(c, h))

    def whole(c: Column, held: Column) -> Column:
        """Pieces joined, and the points where the shape only touches the boundary."""
        empty = F.array().cast("array<struct<lo:double,hi:double>>")
        joined = F.aggregate(
            held,
            empty,
            lambda acc, w: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).hi >= w.lo), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).lo.alias("lo"), w.hi.alias("hi"))))).otherwise(
                F.concat(acc, F.array(w))
            ),
        )
        lone = F.filter(c, lambda r: ~F.exists(held, lambda w: (w.lo <= r) & (r <= w.hi)) & bind(at(r), lambda m: point_on_ring(m, ring, tol)))
        return F.array_sort(F.concat(joined, F.transform(lone, lambda r: F.struct(r.alias("lo"), r.alias("hi")))))

    return F.when(n > 0, bind(cuts, ranges)).otherwise(F.array().cast("array<struct<lo:double,hi:double>>"))


def with_polygon(kind: str, s: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """array of intersection structs of a shape with a filled polygon; empty: they do not meet."""
    from .predicates import point_in_polygon

    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    at = lambda r: pt(s.a.x + r * dx, s.a.y + r * dy)
    length = F.sqrt(dx * dx + dy * dy)

    def part(w: Column) -> Column:
        return F.when((w.hi - w.lo) * length <= tol.point, _result("Cross", [at(w.lo)], "Point", False)).otherwise(
            _result("Cross", [at(w.lo), at(w.hi)], "Segment", bind(at((w.lo + w.hi) / 2), lambda m: point_in_polygon(m, ring, True, tol)))
        )

    return F.transform(inside_ranges(kind, s, ring, tol), part)


def seg_minus_polygon(s: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """The parts of a segment outside the filled polygon, as an array of lines."""
    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    at = lambda r: pt(s.a.x + r * dx, s.a.y + r * dy)
    length = F.sqrt(dx * dx + dy * dy)

    def gaps(w: Column) -> Column:
        lows = F.concat(F.array(F.lit(0.0)), F.transform(w, lambda r: r.hi))
        highs = F.concat(F.transform(w, lambda r: r.lo), F.array(F.lit(1.0)))
        return F.filter(F.zip_with(lows, highs, lambda lo, hi: F.when((hi - lo) * length > tol.point, line(at(lo), at(hi)))), lambda x: x.isNotNull())

    return bind(inside_ranges("seg", s, ring, tol), gaps)


def join_polylines(p: Column, q: Column, tol: Tolerance = DEFAULT) -> Column:
    """One polyline from two that share an end point; NULL where they share none."""
    head, tail = lambda c: F.element_at(c, 1), lambda c: F.element_at(c, -1)
    rest = lambda c: F.slice(c, F.lit(2), F.size(c) - 1)
    return (
        F.when(_same(tail(p), head(q), tol), F.concat(p, rest(q)))
        .when(_same(tail(p), tail(q), tol), F.concat(p, rest(F.reverse(q))))
        .when(_same(head(p), head(q), tol), F.concat(F.reverse(p), rest(q)))
        .when(_same(head(p), tail(q), tol), F.concat(q, rest(p)))
    )


def polyline_in_polygon(seq: Column, ring: Column, tol: Tolerance = DEFAULT) -> Column:
    """The parts of a polyline in the filled polygon, as an array of polylines; parts that touch are one."""
    from .predicates import box_meets_segment
    from .shapes import segments

    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    box = F.struct(F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))
    cut = lambda s: F.transform(with_polygon("seg", s, ring, tol), lambda part: part["points"])
    parts = bind(box, lambda b: F.flatten(F.transform(segments(seq), lambda s: F.when(box_meets_segment(s, b), cut(s)).otherwise(none))))
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")

    def grow(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & _same(F.element_at(last, -1), part[0], tol)
        more = F.slice(part, F.lit(2), F.size(part) - 1)
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, more)))).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, empty, grow)
