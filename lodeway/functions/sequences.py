"""Polylines, timed sequences, moving points and small list helpers (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tolerance import DEFAULT, Tolerance
from .distances import distance, foot_on_line
from .predicates import same_point
from .shapes import bind, line, lit_, norm, pt, segments

TIMED = "array<struct<loc:struct<x:double,y:double>,t:double>>"


def timed(loc: Column, t) -> Column:
    return F.struct(loc.alias("loc"), lit_(t).cast("double").alias("t"))


def _pairs(seq: Column) -> Column:
    n = F.size(seq)
    return F.filter(F.zip_with(F.slice(seq, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(seq, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p.b.isNotNull())


def _between(a: Column, b: Column, t: Column) -> Column:
    u = (t - a["t"]) / (b["t"] - a["t"])
    return pt(a.loc.x + u * (b.loc.x - a.loc.x), a.loc.y + u * (b.loc.y - a.loc.y))


def valid_timed(seq: Column, tol: Tolerance = DEFAULT) -> Column:
    """Times never fall, and no object is at two places at one time."""
    return ~F.exists(_pairs(seq), lambda p: (p.b["t"] < p.a["t"]) | ((p.b["t"] == p.a["t"]) & ~same_point(p.a.loc, p.b.loc, tol)))


def snap(seq: Column, t: Column) -> Column:
    """State at time t: struct(loc, speed, direction); before and after the sequence it rests at its ends."""
    first, last = F.element_at(seq, 1), F.element_at(seq, -1)
    rest = lambda p: F.struct(p.loc.alias("loc"), F.lit(0.0).alias("speed"), F.lit(None).cast("struct<x:double,y:double>").alias("direction"))
    pair = F.filter(_pairs(seq), lambda p: (p.a["t"] <= t) & (t < p.b["t"]))[0]

    def moving(p: Column) -> Column:
        way = distance(p.a.loc, p.b.loc)
        aim = F.when(way > 0, pt((p.b.loc.x - p.a.loc.x) / way, (p.b.loc.y - p.a.loc.y) / way))
        return F.struct(_between(p.a, p.b, t).alias("loc"), (way / (p.b["t"] - p.a["t"])).alias("speed"), aim.alias("direction"))

    return F.when(t <= first["t"], rest(first)).when(t >= last["t"], rest(last)).otherwise(bind(pair, moving))


def trace(seq: Column, start: Column, end: Column) -> Column:
    """Points passed from start to end, with interpolated ends; empty where the times do not meet."""
    first, last = F.element_at(seq, 1), F.element_at(seq, -1)
    empty = F.array().cast("array<struct<x:double,y:double>>")
    lo, hi = F.greatest(start, first["t"]), F.least(end, last["t"])
    within = F.transform(F.filter(seq, lambda p: (p["t"] > lo) & (p["t"] < hi)), lambda p: p.loc)
    whole = F.concat(F.array(snap(seq, lo).loc), within, F.array(snap(seq, hi).loc))
    wrong = F.raise_error(F.lit("start must lie before end")).cast("array<struct<x:double,y:double>>")
    return F.when(start >= end, wrong).when((end < first["t"]) | (start > last["t"]), empty).otherwise(whole)


def to_timed(seq: Column, speed: float, dwell: float = 0.0, start: float = 0.0) -> Column:
    """Arrival at each stop and, with a dwell, departure from all but the last."""
    state = F.struct(F.lit(start).alias("now"), F.array(timed(F.element_at(seq, 1), start)).cast(TIMED).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        leave = acc["now"] + dwell
        arrive = leave + distance(s.a, s.b) / speed
        more = F.array(timed(s.a, leave), timed(s.b, arrive)) if dwell > 0 else F.array(timed(s.b, arrive))
        return F.struct(arrive.alias("now"), F.concat(acc["out"], more).cast(TIMED).alias("out"))

    return F.aggregate(segments(seq), state, step, lambda acc: acc["out"])


def collapse_points(seq: Column, tol: Tolerance = DEFAULT) -> Column:
    """Repeated neighbours become one point."""
    return F.aggregate(
        F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(0))),
        F.slice(seq, 1, 1),
        lambda acc, p: F.when(same_point(F.element_at(acc, -1), p, tol), acc).otherwise(F.concat(acc, F.array(p))),
    )


def remove_degenerate(seq: Column, tol: Tolerance = DEFAULT) -> Column:
    """Repeated points collapsed, then points dropped that lie on the way between their neighbours."""

    def drop(c: Column) -> Column:
        n = F.size(c)

        def step(acc: Column, i: Column) -> Column:
            here, after, before = F.element_at(c, i), F.element_at(c, i + 1), F.element_at(acc, -1)
            bend = distance(before, here) + distance(here, after) - distance(before, after)
            return F.when(bend <= tol.segment, acc).otherwise(F.concat(acc, F.array(here)))

        inner = F.aggregate(F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")), F.slice(c, 1, 1), step)
        return F.when(n > 2, F.concat(inner, F.slice(c, n, F.lit(1)))).otherwise(c)

    return bind(collapse_points(seq, tol), drop)


def mileages_of(seq: Column, p: Column, tol: Tolerance = DEFAULT) -> Column:
    """Ways along a polyline at which it passes a point, in order; off the line, that of the nearest foot."""
    state = F.struct(F.lit(0.0).alias("done"), F.array().cast("array<struct<dist:double,at:double>>").alias("hits"))

    def step(acc: Column, s: Column) -> Column:
        dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
        d = norm(dx, dy)
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((p.x - s.a.x) * dx + (p.y - s.a.y) * dy) / F.when(d > 0, d * d), F.lit(0.0))))
        off = norm(s.a.x + u * dx - p.x, s.a.y + u * dy - p.y)
        hit = F.struct(off.alias("dist"), (acc["done"] + u * d).alias("at"))
        return F.struct((acc["done"] + d).alias("done"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def choose(hits: Column) -> Column:
        near = F.array_sort(F.transform(F.filter(hits, lambda h: h["dist"] <= tol.segment), lambda h: h["at"]))
        merged = F.aggregate(near, F.array().cast("array<double>"), lambda acc, m: F.when((F.size(acc) > 0) & (m - F.element_at(acc, -1) <= tol.segment), acc).otherwise(F.concat(acc, F.array(m))))
        return F.when(F.size(near) > 0, merged).otherwise(F.array(F.array_min(hits)["at"]))

    return bind(F.aggregate(segments(seq), state, step, lambda acc: acc["hits"]), choose)


def velocity(seg: Column) -> Column:
    """struct(origin, v) of a timed segment struct(a, b)."""
    dt = seg.b["t"] - seg.a["t"]
    return F.struct(seg.a.loc.alias("origin"), pt((seg.b.loc.x - seg.a.loc.x) / dt, (seg.b.loc.y - seg.a.loc.y) / dt).alias("v"))


def closest_approach(p: Column, v: Column, q: Column, w: Column, earliest: Column | None = None, latest: Column | None = None) -> Column:
    """struct(dist, t): least distance of two points of constant velocity in [earliest, latest]."""
    dx, dy, ex, ey = q.x - p.x, q.y - p.y, w.x - v.x, w.y - v.y
    square = ex * ex + ey * ey
    free = F.coalesce(-(dx * ex + dy * ey) / F.when(square > 0, square), F.lit(0.0))
    low = earliest if earliest is not None else F.lit(float("-inf"))
    t = F.greatest(free, low)
    t = F.least(t, latest) if latest is not None else t
    return F.struct(norm(dx + t * ex, dy + t * ey).alias("dist"), t.alias("t"))


def timed_segments_distance(one: Column, two: Column, start: Column | float = 0.0) -> Column:
    """Least distance of two objects on timed segments while both are under way; NULL where they never are."""
    lo, hi = F.greatest(one.a["t"], two.a["t"], lit_(start)), F.least(one.b["t"], two.b["t"])
    a, b = velocity(one), velocity(two)
    at = lambda m, s: pt(m.origin.x - m.v.x * s.a["t"], m.origin.y - m.v.y * s.a["t"])
    return F.when(lo <= hi, closest_approach(at(a, one), a.v, at(b, two), b.v, lo, hi)["dist"])


def intercept(origin: Column, speed, target: Column, v: Column) -> Column:
    """struct(t, loc): earliest meeting with a moving target at a given speed; NULL where there is none."""
    speed = lit_(speed).cast("double")
    dx, dy = target.x - origin.x, target.y - origin.y
    abc = F.struct((v.x * v.x + v.y * v.y - speed * speed).alias("a"), (2 * (dx * v.x + dy * v.y)).alias("b"), (dx * dx + dy * dy).alias("c"), target.alias("target"), v.alias("v"))
    return bind(abc, lambda o: _meeting(o["a"], o["b"], o["c"], o["target"], o["v"]))


def _meeting(a: Column, b: Column, c: Column, target: Column, v: Column) -> Column:
    disc = b * b - 4 * a * c
    root = F.sqrt(F.when(disc >= 0, disc))
    flat = F.abs(a) < 1e-12
    one, two = (-b - root) / F.when(~flat, 2 * a), (-b + root) / F.when(~flat, 2 * a)
    later = lambda t: F.when(t >= 0, t)
    t = F.when(c == 0, F.lit(0.0)).when(flat, later(-c / F.when(b != 0, b))).otherwise(F.coalesce(F.least(later(one), later(two))))
    return F.when(t.isNotNull(), F.struct(t.alias("t"), pt(target.x + v.x * t, target.y + v.y * t).alias("loc")))


def hop(p: Column, v: Column, q: Column, w: Column, speed, earliest: float = 0.0, latest: float | None = None, steps: int = 64) -> Column:
    """struct(start, t, dist): shortest straight hop between two moving points, leaving in [earliest, latest].

    The hop's time falls or rises on each side of one minimum along the start
    time, so a ternary search finds it; NULL where none arrives.
    """
    upper = latest if latest is not None else earliest + 1e4

    def cost(s: Column) -> Column:
        arrive = intercept(pt(p.x + v.x * s, p.y + v.y * s), speed, pt(q.x + w.x * s, q.y + w.y * s), w)
        return F.coalesce(arrive["t"], F.lit(1e18))

    def step(acc: Column, _: Column) -> Column:
        third = (acc["hi"] - acc["lo"]) / 3
        left = cost(acc["lo"] + third) <= cost(acc["hi"] - third)
        return F.struct(F.when(left, acc["lo"]).otherwise(acc["lo"] + third).alias("lo"), F.when(left, acc["hi"] - third).otherwise(acc["hi"]).alias("hi"))

    def found(acc: Column) -> Column:
        s = acc["lo"]
        return F.when(cost(s) < 1e17, F.struct(s.alias("start"), cost(s).alias("t"), (cost(s) * lit_(speed)).alias("dist")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(float(earliest)).alias("lo"), F.lit(float(upper)).alias("hi")), step, found)


def true_runs(items: Column, flags: Column) -> Column:
    """Sub-arrays of items under runs of TRUE flags."""
    both = F.arrays_zip(items.alias("item"), flags.alias("flag"))
    state = F.struct(F.lit(False).alias("open"), F.transform(F.slice(items, 1, 0), lambda x: F.array(x)).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        grown = F.when(acc["open"], F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.array(p["item"]))))).otherwise(F.concat(acc["out"], F.array(F.array(p["item"]))))
        return F.struct(F.coalesce(p["flag"], F.lit(False)).alias("open"), F.when(p["flag"], grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(both, state, step, lambda acc: acc["out"])


def split_even(items: Column, bins: int) -> Column:
    """Contiguous parts whose sizes differ by one at most, the larger first."""
    n = F.size(items)
    base, more = F.floor(n / bins).cast("int"), n % bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.slice(items, i * base + F.least(i, more) + 1, base + F.when(i < more, 1).otherwise(0)))


def rule_line(text: str = "", width: int = 75, symbol: str = "-") -> Column:
    """Centered text in a rule."""
    return F.lit(f" {text} ".center(width, symbol) if text else symbol * width)


def list_text(items: Column, commas: bool = True) -> Column:
    return F.to_json(items) if commas else F.regexp_replace(F.to_json(items), ",", " ")


def sorted_tuple(items: Column) -> Column:
    return F.array_sort(items)


def runs_of_flags(df: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """Row form of true_runs: rows with the flag set, with a run number in each group."""
    w = Window.partitionBy(group).orderBy(order)
    start = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return df.withColumn("run", F.sum(start.cast("int")).over(w)).where(F.col(flag))


def foot_mileage(seq: Column, p: Column) -> Column:
    return mileages_of(seq, p)[0]


timed_line = line
foot = foot_on_line
