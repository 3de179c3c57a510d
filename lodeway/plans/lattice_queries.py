"""Queries on points of a small lattice, where coincident, parallel and touching shapes abound."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distances as dist
from ..functions import intersections as ix
from ..functions import predicates as pr
from ..functions import sequences as sq
from ..functions import vectors as vec
from ..functions.shapes import line, pt
from ..operators import aggregates, spatial
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# s runs from a to b, t from c to d; u and v are the places of their crossing, p and q those of c and d along s
_G = fx.with_("lat") + """, g0 AS (SELECT *, bx - ax AS ux, "by" - ay AS uy, dx - cx AS vx, dy - cy AS vy FROM lat),
 g1 AS (SELECT *, ux * vy - uy * vx AS det, ux * (cy - ay) - uy * (cx - ax) AS off, ux * ux + uy * uy AS sq, vx * vx + vy * vy AS sq2 FROM g0),
 g AS (SELECT *, CASE WHEN det <> 0 THEN ((cx - ax) * vy - (cy - ay) * vx) / det END AS u, CASE WHEN det <> 0 THEN ((cx - ax) * uy - (cy - ay) * ux) / det END AS v,
  ((cx - ax) * ux + (cy - ay) * uy) / sq AS p, ((dx - ax) * ux + (dy - ay) * uy) / sq AS q FROM g1)"""
_NAME = {"seg": "Segment", "ray": "Ray", "line": "Line"}


def _meeting(one: str, two: str) -> str:
    """CTE columns status, type and interior of one kind of shape with another."""
    end = {"seg": 1, "ray": "1e18::DOUBLE", "line": "1e18::DOUBLE"}
    start = {"seg": 0, "ray": 0, "line": "-1e18::DOUBLE"}
    within = " AND ".join([f"{w} >= -1e-9" for w, k in (("u", one), ("v", two)) if k != "line"] + [f"{w} <= 1 + 1e-9" for w, k in (("u", one), ("v", two)) if k == "seg"]) or "true"
    border = " OR ".join([f"abs({w}) < 1e-9" for w, k in (("u", one), ("v", two)) if k != "line"] + [f"abs({w} - 1) < 1e-9" for w, k in (("u", one), ("v", two)) if k == "seg"]) or "false"
    low2 = {"seg": "least(p, q)", "ray": "CASE WHEN q >= p THEN p ELSE -1e18::DOUBLE END", "line": "-1e18::DOUBLE"}[two]
    high2 = {"seg": "greatest(p, q)", "ray": "CASE WHEN q >= p THEN 1e18::DOUBLE ELSE p END", "line": "1e18::DOUBLE"}[two]
    return f"""SELECT id, CASE WHEN flat THEN CASE WHEN off = 0 THEN 'Collinear' ELSE 'NoCross' END WHEN hit THEN 'Cross' ELSE 'NoCross' END AS status,
 CASE WHEN flat THEN CASE WHEN off <> 0 OR lo > hi + 1e-9 THEN NULL WHEN abs(hi - lo) <= 1e-9 THEN 'Point' WHEN first_in THEN '{_NAME[one]}' WHEN second_in THEN '{_NAME[two]}' ELSE 'Segment' END WHEN hit THEN 'Point' END AS type,
 CASE WHEN flat THEN CASE WHEN off <> 0 OR lo > hi + 1e-9 THEN NULL ELSE abs(hi - lo) > 1e-9 END WHEN hit THEN NOT ({border}) END AS interior
 FROM (SELECT *, det = 0 AS flat, {within} AS hit, greatest({start[one]}, low2) AS lo, least({end[one]}, high2) AS hi,
  {start[one]} >= low2 - 1e-9 AND {end[one]} <= high2 + 1e-9 AS first_in, low2 >= {start[one]} - 1e-9 AND high2 <= {end[one]} + 1e-9 AS second_in
  FROM (SELECT *, {low2} AS low2, {high2} AS high2 FROM g))"""


def _meetings(one: str) -> None:
    name = f"{one}_meetings"
    kinds = ("seg", "ray", "line")

    def run(spark, sf_dir):
        rows = fx.lattice(spark, sf_dir).select("id", line(F.col("a"), F.col("b")).alias("s"), line(F.col("c"), F.col("d")).alias("t"))
        s, t = F.col("s"), F.col("t")
        for two in kinds:
            rows = rows.withColumn(two, getattr(ix, f"{one}_{two}")(s, t))
        out = ["id"]
        for two in kinds:
            meets = getattr(pr, f"{one}_meets_{two}")
            out += [F.col(f"{two}.status").alias(f"{two}_status"), F.col(f"{two}.type").alias(f"{two}_type"), F.col(f"{two}.interior").alias(f"{two}_interior"), meets(s, t).alias(f"meets_{two}"), meets(s, t, True).alias(f"meets_{two}_inside")]
        return rows.select(*out)

    ctes = ", ".join(f"{two}_ AS ({_meeting(one, two)})" for two in kinds)
    cells = ", ".join(f"{two}_.status AS {two}_status, {two}_.type AS {two}_type, {two}_.interior AS {two}_interior, {two}_.type IS NOT NULL AS meets_{two}, {two}_.type IS NOT NULL AND coalesce({two}_.interior, false) AS meets_{two}_inside" for two in kinds)
    QUERIES[name] = run
    ORACLES[name] = f"{_G}, {ctes} SELECT seg_.id, {cells} FROM seg_ JOIN ray_ USING (id) JOIN line_ USING (id)"


for _one in ("seg", "ray", "line"):
    _meetings(_one)


@query(
    _G
    + """, o AS (SELECT *, off = 0 AND (cx - ax) * ux + (cy - ay) * uy BETWEEN 0 AND sq AS c_on, ux * (dy - ay) - uy * (dx - ax) = 0 AND (dx - ax) * ux + (dy - ay) * uy BETWEEN 0 AND sq AS d_on,
  vx * (ay - cy) - vy * (ax - cx) = 0 AND (ax - cx) * vx + (ay - cy) * vy BETWEEN 0 AND sq2 AS a_on, vx * ("by" - cy) - vy * (bx - cx) = 0 AND (bx - cx) * vx + ("by" - cy) * vy BETWEEN 0 AND sq2 AS b_on,
  (cx = ax AND cy = ay) AS ca, (cx = bx AND cy = "by") AS cb FROM g)
SELECT id, ca AS same_point, (ca AND dx = bx AND dy = "by") OR (cb AND dx = ax AND dy = ay) AS same_segment, det = 0 AS parallel,
 CASE WHEN off = 0 THEN NULL ELSE off < 0 END AS clockwise, off = 0 AS on_line, c_on AS on_segment, c_on AND NOT ca AND NOT cb AS inside_segment,
 off = 0 AND (cx - ax) * ux + (cy - ay) * uy >= 0 AS on_ray, off = 0 AND (cx - ax) * ux + (cy - ay) * uy >= 0 AND NOT ca AS inside_ray,
 det = 0 AND off = 0 AS collinear, det = 0 AND (a_on OR b_on OR c_on OR d_on) AS overlapping,
 NOT (greatest(ax, ay) < least(cx, cy) OR greatest(cx, cy) < least(ax, ay)) AS intervals
FROM o"""
)
def lattice_predicates(spark, sf_dir):
    rows = fx.lattice(spark, sf_dir).withColumns({"s": line(F.col("a"), F.col("b")), "t": line(F.col("c"), F.col("d"))})
    a, b, c, s, t = (F.col(x) for x in "abcst")
    return rows.select(
        "id", pr.same_point(c, a).alias("same_point"), pr.same_segment(s, t).alias("same_segment"), pr.parallel(s, t).alias("parallel"), pr.clockwise(a, b, c).alias("clockwise"), pr.point_on_line(c, s).alias("on_line"),
        pr.point_on_segment(c, s).alias("on_segment"), pr.point_on_segment(c, s, True).alias("inside_segment"), pr.point_on_ray(c, s).alias("on_ray"), pr.point_on_ray(c, s, True).alias("inside_ray"),
        pr.collinear_segments(s, t).alias("collinear"), pr.overlapping_segments(s, t).alias("overlapping"), pr.intervals_overlap(a.x, a.y, c.x, c.y).alias("intervals"),
    )


@query(
    fx.with_("lat")
    + """, s AS (SELECT id, ax, ay, bx, "by" AS b_y, cx, cy, dx, dy, (dx - cx) * (ax - cx) + (dy - cy) * (ay - cy) AS dot, (dx - cx) * (dx - cx) + (dy - cy) * (dy - cy) AS sq, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS turn FROM lat),
 f AS (SELECT *, cx + dot / sq * (dx - cx) AS fx, cy + dot / sq * (dy - cy) AS fy, sqrt((bx - cx) * (bx - cx) + (b_y - cy) * (b_y - cy)) AS bc, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS ab FROM s),
 e AS (SELECT *, greatest(0, least(1, CASE WHEN bc > 0 THEN ((ax - bx) * (cx - bx) + (ay - b_y) * (cy - b_y)) / (bc * bc) ELSE 0 END)) AS w, greatest(0, least(1, dot / sq)) AS z FROM f)
SELECT id, round(fx, 6) AS foot_x, round(fy, 6) AS foot_y, turn = 0 AS on_it, round(abs(turn) / sqrt(sq), 6) AS to_line, round(sqrt((cx + z * (dx - cx) - ax) ** 2 + (cy + z * (dy - cy) - ay) ** 2), 6) AS to_segment,
 round(CASE WHEN dot >= 0 THEN abs(turn) / sqrt(sq) ELSE sqrt((ax - cx) ** 2 + (ay - cy) ** 2) END, 6) AS to_ray,
 round(least(sqrt((bx + w * (cx - bx) - ax) ** 2 + (b_y + w * (cy - b_y) - ay) ** 2), sqrt((cx + z * (dx - cx) - ax) ** 2 + (cy + z * (dy - cy) - ay) ** 2)), 6) AS to_polyline,
 round(abs((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) / 2, 6) AS area, round(sqrt(greatest(0, (ab + bc + ca) / 2 * ((ab + bc + ca) / 2 - ab) * ((ab + bc + ca) / 2 - bc) * ((ab + bc + ca) / 2 - ca))), 4) AS area_by_sides
FROM (SELECT *, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS ca FROM e)"""
)
def lattice_distances(spark, sf_dir):
    rows = fx.lattice(spark, sf_dir).withColumn("t", line(F.col("c"), F.col("d")))
    a, b, c, d, t = (F.col(x) for x in "abcdt")
    foot = F.when(pr.point_on_line(a, t), a).otherwise(dist.perpendicular_ray(a, t).b)
    r = lambda x, n=6: F.round(x, n)
    return rows.select(
        "id", (r(foot.x) + 0.0).alias("foot_x"), (r(foot.y) + 0.0).alias("foot_y"), pr.point_on_line(a, t).alias("on_it"), r(dist.to_line(a, t)).alias("to_line"), r(dist.to_segment(a, t)).alias("to_segment"), r(dist.to_ray(a, t)).alias("to_ray"),
        r(dist.to_polyline(a, F.array("b", "c", "d"))["dist"]).alias("to_polyline"), r(vec.triangle_area(a, b, c)).alias("area"), r(vec.triangle_area_by_sides(dist.euclidean(a, b), dist.euclidean(b, c), dist.euclidean(c, a)), 4).alias("area_by_sides"),
    )


@query(
    fx.with_("lat")
    + """, v AS (SELECT id, bx - ax AS vx, "by" - ay AS vy, dx - cx AS wx, dy - cy AS wy FROM lat),
 d AS (SELECT *, vx + wx AS sx, vy + wy AS sy, vx - wx AS mx, vy - wy AS my FROM v)
SELECT id, round(sqrt(vx * vx + vy * vy), 6) AS norm, round(CASE WHEN degrees(atan2(vx, vy)) < 0 THEN degrees(atan2(vx, vy)) + 360 ELSE degrees(atan2(vx, vy)) END, 4) AS deg,
 round(sqrt(sx * sx + sy * sy), 6) AS sum_norm, round(sqrt(mx * mx + my * my), 6) AS less_norm,
 CASE WHEN sx = 0 AND sy = 0 THEN NULL ELSE round(CASE WHEN degrees(atan2(sx, sy)) < 0 THEN degrees(atan2(sx, sy)) + 360 ELSE degrees(atan2(sx, sy)) END, 3) % 360 END AS sum_deg,
 CASE WHEN mx = 0 AND my = 0 THEN NULL ELSE round(CASE WHEN degrees(atan2(mx, my)) < 0 THEN degrees(atan2(mx, my)) + 360 ELSE degrees(atan2(mx, my)) END, 3) % 360 END AS less_deg FROM d"""
)
def lattice_vectors(spark, sf_dir):
    rows = fx.lattice(spark, sf_dir)
    a, b, c, d = (F.col(x) for x in "abcd")
    v, w = vec.xy_to_polar(pt(b.x - a.x, b.y - a.y)), vec.xy_to_polar(pt(d.x - c.x, d.y - c.y))
    plus, minus = vec.polar_add(v, w), vec.polar_subtract(v, w)
    turn = lambda x: F.when(F.round(x["norm"], 6) > 0, F.round(x["deg"], 3) % 360)
    return rows.select("id", F.round(v["norm"], 6).alias("norm"), F.round(v["deg"], 4).alias("deg"), F.round(plus["norm"], 6).alias("sum_norm"), F.round(minus["norm"], 6).alias("less_norm"), turn(plus).alias("sum_deg"), turn(minus).alias("less_deg"))


# a shape against a rectangle: the range of its parameter between the sides
_CLIP = fx.with_("lac", "rect") + """, s AS (SELECT id, poly_id, x0, x1, y0, y1, ax * 6 AS ax, ay * 6 AS ay, (bx - ax) * 6 AS ux, ("by" - ay) * 6 AS uy FROM lac, rect),
 c AS (SELECT *, sqrt(ux * ux + uy * uy) AS len, CASE WHEN ux = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN -1e18::DOUBLE ELSE 1e18::DOUBLE END ELSE least((x0 - ax) / ux, (x1 - ax) / ux) END AS tx0,
  CASE WHEN ux = 0 THEN 1e18::DOUBLE ELSE greatest((x0 - ax) / ux, (x1 - ax) / ux) END AS tx1, CASE WHEN uy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN -1e18::DOUBLE ELSE 1e18::DOUBLE END ELSE least((y0 - ay) / uy, (y1 - ay) / uy) END AS ty0,
  CASE WHEN uy = 0 THEN 1e18::DOUBLE ELSE greatest((y0 - ay) / uy, (y1 - ay) / uy) END AS ty1 FROM s),
 r AS (SELECT *, greatest(tx0, ty0, {low}) AS t0, least(tx1, ty1, {high}) AS t1 FROM c),
 m AS (SELECT *, ax + (t0 + t1) / 2 * ux AS mx, ay + (t0 + t1) / 2 * uy AS my FROM r WHERE t0 <= t1 + 1e-9)
SELECT id, poly_id, CASE WHEN (t1 - t0) * len <= 0.01 THEN 'Point' ELSE 'Segment' END AS type, round(greatest(t1 - t0, 0) * len, 4) AS way,
 (t1 - t0) * len > 0.01 AND mx > x0 + 0.001 AND mx < x1 - 0.001 AND my > y0 + 0.001 AND my < y1 - 0.001 AS interior{more} FROM m"""


def _with_rectangles(kind: str, low: str, high: str, more: str = "") -> None:
    def run(spark, sf_dir):
        six = lambda p: pt(p.x * 6, p.y * 6)
        rows = fx.lattice(spark, sf_dir, "customer", "c_custkey").select("id", line(six(F.col("a")), six(F.col("b"))).alias("s"))
        # equal shapes are worked on once
        met = spatial.shapes_near_polygons(kind, rows.select("s").distinct(), fx.rectangles(spark, sf_dir)).withColumn("parts", F.explode(F.array(ix.with_polygon(kind, F.col("s"), F.col("poly"))))).where("size(parts) > 0")
        part = F.col("parts")[0]
        extra = [F.round(F.aggregate(ix.seg_minus_polygon(F.col("s"), F.col("poly")), F.lit(0.0), lambda acc, x: acc + dist.euclidean(x.a, x.b)), 4).alias("outside"), pr.box_meets_segment(F.col("s"), spatial.box_struct("poly")).alias("box")] if kind == "seg" else []
        found = met.select("s", "poly_id", part["type"].alias("type"), F.round(F.when(part["type"] == "Point", F.lit(0.0)).otherwise(dist.euclidean(part["points"][0], part["points"][1])), 4).alias("way"), part["interior"].alias("interior"), *extra)
        return rows.join(found, "s").drop("s")

    QUERIES[f"{kind}_rectangle_parts"] = run
    ORACLES[f"{kind}_rectangle_parts"] = _CLIP.format(low=low, high=high, more=more).replace("round(greatest(t1 - t0, 0) * len, 4) AS way", "round(CASE WHEN (t1 - t0) * len <= 0.01 THEN 0 ELSE (t1 - t0) * len END, 4) AS way")


_with_rectangles("seg", "0", "1", more=", round(len - CASE WHEN t0 * len > 0.01 OR true THEN (t1 - t0) * len END, 4) AS outside, true AS box")
_with_rectangles("ray", "0", "1e18::DOUBLE")
_with_rectangles("line", "-1e18::DOUBLE", "1e18::DOUBLE")


@query(
    fx.with_("rect")
    + """, p AS (SELECT a.poly_id AS p, b.poly_id AS q, greatest(0, a.x0 - b.x1, b.x0 - a.x1) AS gx, greatest(0, a.y0 - b.y1, b.y0 - a.y1) AS gy,
  least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy FROM rect a, rect b WHERE a.poly_id <= b.poly_id)
SELECT p, q, round(sqrt(gx * gx + gy * gy), 6) AS dist, ox >= 0 AND oy >= 0 AS meets, ox > 0 AND oy > 0 AS inside FROM p"""
)
def rectangle_pairs(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    a, b = r.select(F.col("poly_id").alias("p"), F.col("poly").alias("u")), r.select(F.col("poly_id").alias("q"), F.col("poly").alias("v"))
    u, v = F.col("u"), F.col("v")
    return a.join(b, F.col("p") <= F.col("q")).select("p", "q", F.round(dist.polygon_to_polygon(u, v), 6).alias("dist"), pr.polygon_meets_polygon(u, v).alias("meets"), pr.polygon_meets_polygon(u, v, True).alias("inside"))


_CELLS = fx.with_("rect") + ", cell AS (SELECT i + 0.5::DOUBLE AS x, j + 0.5::DOUBLE AS y FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j)), held AS (SELECT region_id, x, y, count(*) AS n, bool_or(poly_id % 2 = 1) AS odd, bool_or(poly_id % 2 = 0) AS even FROM rect JOIN cell ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY region_id, x, y), size AS (SELECT region_id, count(*) AS m FROM rect GROUP BY region_id) "


@query(_CELLS + "SELECT region_id AS group_id, CAST(count(*) AS DOUBLE) AS area FROM held GROUP BY region_id")
def rectangle_unions(spark, sf_dir):
    out = aggregates.polygon_union(fx.rectangles(spark, sf_dir), "region_id", key="poly_id")
    return out.groupBy("group_id").agg(F.round(F.sum(vec.area(F.col("poly"))), 4).alias("area"))


@query(_CELLS + "SELECT region_id AS group_id, CAST(count(*) FILTER (even AND NOT odd) AS DOUBLE) AS area FROM held GROUP BY region_id HAVING count(*) FILTER (even AND NOT odd) > 0")
def rectangle_differences(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    out = aggregates.polygon_difference(r.where("poly_id % 2 = 0"), r.where("poly_id % 2 = 1"), "region_id")
    return out.groupBy("group_id").agg(F.round(F.sum(vec.area(F.col("poly"))), 4).alias("area"))


@query(
    fx.with_("rect")
    + """SELECT CAST(a.poly_id * 100 + b.poly_id AS BIGINT) AS group_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
FROM rect a, rect b WHERE a.poly_id < b.poly_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"""
)
def rectangle_intersections(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    pairs = spatial.polygon_overlaps(r.select(F.col("poly_id").alias("p"), "poly"), r.select(F.col("poly_id").alias("q"), "poly"), "p", "q").where("p < q")
    both = pairs.select((F.col("p") * 100 + F.col("q")).alias("g"), F.explode(F.array("p", "q")).alias("poly_id")).join(r.select("poly_id", "poly"), "poly_id")
    out = aggregates.polygon_intersection(both, "g", key="poly_id").withColumn("area", F.round(vec.area(F.col("poly")), 4)).where("area > 0")
    return out.groupBy("group_id").agg(F.sum("area").alias("area"))


@query(
    fx.with_("rect")
    + """SELECT poly_id, false AS cw, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, true AS turned, false AS kept, 2 AS n_triangles, (x1 - x0) * (y1 - y0) AS triangles_area,
 true AS edge, false AS outside FROM rect"""
)
def rectangle_turns(spark, sf_dir):
    from ..functions.overlays import triangulate

    p = F.col("poly")
    c = dist.centroid(p)
    rows = fx.rectangles(spark, sf_dir).withColumn("tri", triangulate(p))
    return rows.select(
        "poly_id", vec.is_clockwise(p).alias("cw"), vec.area(p).alias("area"), vec.perimeter(p).alias("perimeter"), F.round(c.x, 6).alias("cx"), F.round(c.y, 6).alias("cy"), vec.is_clockwise(vec.to_clockwise(p)).alias("turned"), vec.is_clockwise(vec.to_counter_clockwise(p)).alias("kept"),
        F.size("tri").alias("n_triangles"), F.round(F.aggregate("tri", F.lit(0.0), lambda acc, t: acc + vec.area(t)), 6).alias("triangles_area"), pr.point_on_ring(pt((p[0].x + p[1].x) / 2, p[0].y), p).alias("edge"), pr.point_in_polygon(pt(p[0].x - 1, p[0].y), p, True).alias("outside"),
    )


@query(
    fx.with_("lat")
    + """, e AS (SELECT id, sqrt((bx - ax) ** 2 + ("by" - ay) ** 2) AS d1, sqrt((cx - bx) ** 2 + (cy - "by") ** 2) AS d2, sqrt((dx - cx) ** 2 + (dy - cy) ** 2) AS d3, ax, ay, bx, "by" AS b_y, cx, cy, dx, dy FROM lat),
 k AS (SELECT *, (bx - ax) / 10 AS vx, (b_y - ay) / 10 AS vy, (dx - cx) / 20 AS wx, (dy - cy) / 20 AS wy FROM e),
 r AS (SELECT *, (cx - 5 * wx) - ax AS px, (cy - 5 * wy) - ay AS py, wx - vx AS qx, wy - vy AS qy FROM k),
 t AS (SELECT *, least(10, greatest(5, CASE WHEN qx * qx + qy * qy > 0 THEN -(px * qx + py * qy) / (qx * qx + qy * qy) ELSE 0 END)) AS t FROM r)
SELECT id, round(d1 / 2 + d2 / 2 + d3 / 2 + 3, 6) AS arrival, 7 AS n_times, round(sqrt((px + t * qx) ** 2 + (py + t * qy) ** 2), 6) AS apart, round(vx, 6) AS vx, round(vy, 6) AS vy, true AS valid FROM t"""
)
def lattice_moves(spark, sf_dir):
    rows = fx.lattice(spark, sf_dir)
    a, b, c, d = (F.col(x) for x in "abcd")
    way = sq.to_timed(F.array("a", "b", "c", "d"), 2.0, 1.0)
    one = F.struct(sq.timed(a, 0.0).alias("a"), sq.timed(b, 10.0).alias("b"))
    two = F.struct(sq.timed(c, 5.0).alias("a"), sq.timed(d, 25.0).alias("b"))
    v = sq.velocity(one)["v"]
    return rows.select("id", F.round(F.element_at(way, -1)["t"], 6).alias("arrival"), F.size(way).alias("n_times"), F.round(sq.timed_segments_distance(one, two), 6).alias("apart"), F.round(v.x, 6).alias("vx"), F.round(v.y, 6).alias("vy"), sq.valid_timed(way).alias("valid"))


@query(
    fx.with_("lat")
    + """, p AS (SELECT id, ax, ay, bx, "by" AS b_y, cx, cy, dx, dy FROM lat),
 g AS (SELECT *, radians(ax) AS phi, radians(ay) AS lam, ln(tan(pi() / 4 + radians(ax) / 2)) * 6378137.0::DOUBLE AS north, radians(ay) * 6378137.0::DOUBLE AS east FROM p)
SELECT id, round(ax, 6) AS lat, round(ay, 6) AS lon, round(north, 2) + 0 AS north, round(east, 2) + 0 AS east,
 CASE WHEN bx = cx AND b_y = cy THEN 5 WHEN bx = dx AND b_y = dy THEN 4 WHEN ax = cx AND ay = cy THEN 3 WHEN ax = dx AND ay = dy THEN 2 ELSE 0 END AS joined FROM g"""
)
def lattice_projections(spark, sf_dir):
    rows = fx.lattice(spark, sf_dir)
    a, b, c, d = (F.col(x) for x in "abcd")
    flat = vec.polygon_geographic_to_mercator(F.array("a", "b"))
    back = vec.polygon_mercator_to_geographic(flat)[0]
    # b-c of a-b joined with c-d: the case by which two polylines of two points share an end
    j = ix.join_polylines(F.array("a", "b"), F.array("c", "d"))
    same = lambda p, q: pr.same_point(p, q)
    case = F.when(j.isNull(), 0).when(same(b, c), 5).when(same(b, d), 4).when(same(a, c), 3).otherwise(2)
    return rows.select("id", (F.round(back.x, 6) + 0.0).alias("lat"), (F.round(back.y, 6) + 0.0).alias("lon"), (F.round(flat[0].x, 2) + 0.0).alias("north"), (F.round(flat[0].y, 2) + 0.0).alias("east"), F.when(F.size(j) == 3, case).otherwise(0).alias("joined"))
