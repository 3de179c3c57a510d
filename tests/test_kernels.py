"""Hand-checked cases of the column kernels."""

import math

import pytest
from pyspark.sql import functions as F

from lodeway.errors import UnsupportedInputError
from lodeway.functions import distances as d
from lodeway.functions import intersections as ix
from lodeway.functions import predicates as pr
from lodeway.functions import sequences as sq
from lodeway.functions import vectors as v
from lodeway.functions.shapes import line, poly, pt
from lodeway.operators import structures as st
from lodeway.tolerance import DEFAULT


def p(xy):
    return pt(float(xy[0]), float(xy[1]))


def s(a, b):
    return line(p(a), p(b))


@pytest.fixture
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return get


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize("pts,want", [(((0, 0), (0, 1), (1, 1)), True), (((0, 0), (1, 1), (2, 2)), None), (((0, 0), (1, 0), (1, 1)), False)])
def test_clockwise(value, pts, want):
    assert value(pr.clockwise(*map(p, pts))) is want


def test_same_point(value):
    assert value(pr.same_point(p((0, 0)), p((0.009, 0)))) is True
    assert value(pr.same_point(p((0, 0)), p((0.01, 0)))) is False


def test_point_on_segment(value):
    seg = s((0, 0), (2, 2))
    assert value(pr.point_on_segment(p((1, 1)), seg)) and value(pr.point_on_segment(p((1, 1)), seg, True))
    assert value(pr.point_on_segment(p((0, 0)), seg)) and not value(pr.point_on_segment(p((0, 0)), seg, True))
    assert value(pr.point_on_ray(p((5, 5)), seg)) and not value(pr.point_on_ray(p((-1, -1)), seg))
    assert value(pr.point_on_line(p((-1, -1)), seg))


def test_line_line(value):
    r = value(ix.line_line(s((0, 0), (1, 1)), s((0, 2), (2, 0))))
    assert (r["status"], r["type"]) == ("Cross", "Point") and (r["points"][0]["x"], r["points"][0]["y"]) == (1, 1)
    assert value(ix.line_line(s((0, 0), (1, 0)), s((0, 1), (1, 1))))["status"] == "NoCross"
    assert value(ix.line_line(s((0, 0), (1, 0)), s((5, 0), (7, 0))))["type"] == "Line"


@pytest.mark.parametrize(
    "a,b,status,kind,points,interior",
    [
        (((0, 0), (1, 0)), ((1, 0), (2, 0)), "Collinear", "Point", [(1, 0)], False),
        (((0, 0), (2, 0)), ((1, 0), (3, 0)), "Collinear", "Segment", [(2, 0), (1, 0)], True),
        (((0, 0), (1, 0)), ((2, 0), (3, 0)), "Collinear", None, None, None),
        (((1, 0), (2, 0)), ((0, 0), (3, 0)), "Collinear", "Segment", [(1, 0), (2, 0)], True),
        (((0, 0), (3, 0)), ((2, 0), (1, 0)), "Collinear", "Segment", [(2, 0), (1, 0)], True),
        (((0, 0), (2, 2)), ((0, 2), (2, 0)), "Cross", "Point", [(1, 1)], True),
        (((0, 0), (2, 2)), ((2, 2), (4, 0)), "Cross", "Point", [(2, 2)], False),
        (((0, 0), (1, 1)), ((0, 5), (5, 0)), "NoCross", None, None, None),
    ],
)
def test_seg_seg(value, a, b, status, kind, points, interior):
    r = value(ix.seg_seg(s(*a), s(*b)))
    got = None if r["points"] is None else [(q["x"], q["y"]) for q in r["points"]]
    assert (r["status"], r["type"], got, r["interior"]) == (status, kind, points, interior)


def test_rays(value):
    facing = value(ix.ray_ray(s((0, 0), (1, 0)), s((5, 0), (4, 0))))
    assert facing["type"] == "Segment" and [q["x"] for q in facing["points"]] == [0, 5]
    nested = value(ix.ray_ray(s((0, 0), (1, 0)), s((5, 0), (6, 0))))
    assert nested["type"] == "Ray" and nested["points"][0]["x"] == 5
    away = value(ix.ray_ray(s((0, 0), (-1, 0)), s((5, 0), (6, 0))))
    assert away["points"] is None
    assert value(ix.seg_ray(s((0, 0), (2, 0)), s((1, 0), (9, 0))))["type"] == "Segment"


def test_segment_and_polygon(value):
    ring = poly(SQUARE)
    through = value(ix.with_polygon("seg", s((-5, 5), (15, 5)), ring))
    assert len(through) == 1 and through[0]["interior"] and [q["x"] for q in through[0]["points"]] == [0, 10]
    touch = value(ix.with_polygon("seg", s((-5, 5), (5, 15)), ring))
    assert [t["type"] for t in touch] == ["Point"] and not touch[0]["interior"]
    assert value(ix.with_polygon("seg", s((20, 0), (30, 5)), ring)) == []
    outside = value(ix.seg_minus_polygon(s((-5, 5), (15, 5)), ring))
    assert [(q["a"]["x"], q["b"]["x"]) for q in outside] == [(-5, 0), (10, 15)]
    assert value(ix.with_polygon("line", s((0, 5), (1, 5)), ring))[0]["type"] == "Segment"
    assert value(pr.seg_meets_polygon(s((2, 2), (3, 3)), ring, True))
    concave = poly([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)])
    assert len(value(ix.with_polygon("seg", s((-1, 5), (11, 5)), concave))) == 2


def test_polylines(value):
    a, b = poly([(0, 0), (1, 0)]), poly([(2, 0), (1, 0)])
    assert [q["x"] for q in value(ix.join_polylines(a, b))] == [0, 1, 2]
    assert value(ix.join_polylines(a, poly([(5, 5), (6, 6)]))) is None
    inside = value(ix.polyline_in_polygon(poly([(-5, 5), (5, 5), (5, 20)]), poly(SQUARE)))
    assert len(inside) == 1 and [(q["x"], q["y"]) for q in inside[0]] == [(0, 5), (5, 5), (5, 10)]


def test_polygons(value):
    ring = poly(SQUARE)
    assert value(v.area(poly([(0, 0), (1, 0), (1, 1), (0, 1)]))) == 1
    assert value(pr.simple_polygon(ring)) and not value(pr.simple_polygon(poly([(0, 0), (10, 10), (10, 0), (0, 10)])))
    assert value(pr.point_in_polygon(p((5, 5)), ring)) and not value(pr.point_in_polygon(p((0, 5)), ring, True))
    assert value(pr.polygon_meets_polygon(ring, poly([(10, 0), (20, 0), (20, 10), (10, 10)])))
    assert not value(pr.polygon_meets_polygon(ring, poly([(10, 0), (20, 0), (20, 10), (10, 10)]), True))
    assert value(d.polygon_to_polygon(ring, poly([(13, 0), (20, 0), (20, 10), (13, 10)]))) == 3
    c = value(d.centroid(ring))
    assert (c["x"], c["y"]) == (5, 5)
    assert not value(v.is_clockwise(ring)) and value(v.is_clockwise(v.to_clockwise(ring)))
    assert value(d.line_to_polygon(s((0, 13), (1, 13)), ring))["dist"] == 3


def test_directions(value):
    assert [value(d.heading(p((0, 0)), p(q))) for q in ((1, 0), (0, 1), (-1, 0))] == [90, 0, 270]
    at = value(d.at_bearing(p((0, 0)), 90, 10))
    assert math.isclose(at["x"], 10) and abs(at["y"]) < 1e-9
    assert math.isclose(value(d.great_circle(p((0, 0)), p((1, 0)))), 6378137 * math.pi / 180, rel_tol=1e-9)
    back = value(v.mercator_to_geographic(v.geographic_to_mercator(p((48.1, 11.5)))))
    assert math.isclose(back["x"], 48.1) and math.isclose(back["y"], 11.5)
    with pytest.raises(UnsupportedInputError):
        d.great_circle(p((0, 0)), p((1, 0)), "yard")


def test_geodesic_destination(spark):
    out = spark.range(1).select(d.at_bearing_geographic(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(111319.49079327358)).alias("q")).first()["q"]
    assert abs(out["x"]) < 1e-9 and math.isclose(out["y"], 1.0, rel_tol=1e-9)


def _timed(*rows):
    return F.array(*(sq.timed(p(xy), t) for xy, t in rows))


def test_snap_and_trace(value):
    seq = _timed(((0, 0), 0), ((10, 0), 10))
    assert [value(sq.snap(seq, F.lit(float(t))).loc.x) for t in (4, -1, 10)] == [4, 0, 10]
    assert [value(sq.snap(seq, F.lit(float(t)))["speed"]) for t in (4, -1, 10)] == [1, 0, 0]
    assert [q["x"] for q in value(sq.trace(seq, F.lit(2.0), F.lit(5.0)))] == [2, 5]
    assert value(sq.trace(seq, F.lit(20.0), F.lit(25.0))) == []
    assert value(sq.valid_timed(seq)) and not value(sq.valid_timed(_timed(((0, 0), 0), ((5, 0), 0))))


def test_timed_sequence(value):
    out = value(sq.to_timed(poly([(0, 0), (3, 4)]), 1.0, 2.0))
    assert [(r["loc"]["x"], r["loc"]["y"], r["t"]) for r in out] == [(0, 0, 0), (0, 0, 2), (3, 4, 7)]


def test_degenerate(value):
    out = value(sq.remove_degenerate(poly([(0, 0), (0, 0), (1, 0), (2, 0), (2, 2), (2, 2)])))
    assert [(q["x"], q["y"]) for q in out] == [(0, 0), (2, 0), (2, 2)]
    assert value(sq.mileages_of(poly([(0, 0), (10, 0), (10, 10), (5, 10), (5, 0)]), p((5, 0)))) == [5, 35]


def test_moving_points(value):
    got = value(sq.intercept(p((0, 0)), 1.0, p((10, 0)), p((0.5, 0))))
    assert (got["t"], got["loc"]["x"]) == (20, 20)
    assert value(sq.intercept(p((0, 0)), 1.0, p((10, 0)), p((2, 0)))) is None
    near = value(sq.closest_approach(p((0, 0)), p((1, 0)), p((10, 1)), p((-1, 0))))
    assert (near["dist"], near["t"]) == (1, 5)
    hop = value(sq.hop(p((0, 0)), p((0, 0)), p((10, 0)), p((-1, 0)), 1.0, 0.0, 9.0))
    assert hop["t"] < 0.6 and hop["start"] > 8.9


def test_lists(value):
    ids = F.array(*map(F.lit, "abcd"))
    assert value(sq.true_runs(ids, F.array(F.lit(True), F.lit(True), F.lit(False), F.lit(True)))) == [["a", "b"], ["d"]]
    assert [len(x) for x in value(sq.split_even(F.sequence(F.lit(1), F.lit(10)), 3))] == [4, 3, 3]


def test_rings(value):
    ring = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    assert value(st.rehead(ring, 3)) == [3, 4, 5, 1, 2]
    assert value(st.insert_after(ring, 2, 9)) == [1, 2, 9, 3, 4, 5]
    assert value(st.swap_with_next(ring, 5)) == [5, 2, 3, 4, 1]
    assert value(st.exchange(ring, 1, 4)) == [4, 2, 3, 1, 5]
    assert value(st.rotate(ring, 2, 4)) == [1, 4, 3, 2, 5]
    assert value(st.reverse(ring)) == [1, 5, 4, 3, 2]
    assert value(st.remove(ring, 3)) == [1, 2, 4, 5]


def test_schedule(value):
    window = "array<struct<lo:double,hi:double>>"
    job = lambda i, n, w: F.struct(F.lit(i).cast("long").alias("id"), F.lit(float(n)).alias("length"), F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in w)).cast(window).alias("windows"))
    jobs = F.array(job(1, 2, []), job(2, 3, [(5, 6), (10, 20)]), job(3, 1, [(0, 1)]))
    assert [(j["ts"], j["te"]) for j in value(st.schedule(jobs))] == [(0, 2), (5, 8), (None, None)]
    assert value(st.makespan(st.remove_job(jobs, 3))) == 8
    best = value(st.cheapest_job_insertion(st.remove_job(jobs, 3), job(4, 1, [])))
    assert (best["makespan"], best["position"]) == (8, 0)


def test_colours(value):
    assert value(v.complement(F.lit("#102030"))) == "#302010"
    assert value(v.text_colour(F.lit("#ffffff"))) == "black" and value(v.text_colour(F.lit("#000000"))) == "white"


def test_tolerance():
    assert DEFAULT.with_(point=1.0).point == 1.0
    with pytest.raises(UnsupportedInputError):
        DEFAULT.with_(nothing=1.0)
