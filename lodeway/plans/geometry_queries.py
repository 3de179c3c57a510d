"""Queries on the scalar geometry kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distances as dist
from ..functions import intersections as ix
from ..functions import predicates as pr
from ..functions import sequences as sq
from ..functions import vectors as vec
from ..functions.shapes import line, pt
from ..operators import spatial
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


r6 = lambda c: F.round(c, 6)

SAME = "(abs({0} - {2}) < 0.01 AND abs({1} - {3}) < 0.01)"
FLAT = f"({SAME.format('ax', 'ay', 'bx', 'by_')} OR {SAME.format('bx', 'by_', 'cx', 'cy')} OR {SAME.format('ax', 'ay', 'cx', 'cy')} OR abs(turn) <= 0.001)"


@query(
    fx.with_("fix", "mv")
    + f""", m AS (SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS turn, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS d1,
  sqrt((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_)) AS d2, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS d3 FROM mv)
SELECT event_id, {SAME.format('ax', 'ay', 'bx', 'by_')} AS same_ab, CASE WHEN {FLAT} THEN 'none' WHEN turn < 0 THEN 'right' ELSE 'left' END AS side,
  {FLAT} AND abs(d1 + d2 - d3) <= 0.01 AS b_on_ac, {FLAT} AS collinear,
  abs((bx - ax) * (cy - by_) - (by_ - ay) * (cx - bx)) <= 0.001 * (d1 * d2) AS is_parallel FROM m WHERE d1 > 0.02 AND d2 > 0.02 AND d3 > 0.02"""
)
def point_predicates(spark, sf_dir):
    m = fx.moves(spark, sf_dir)
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("n.b")
    long = (dist.euclidean(a, b) > 0.02) & (dist.euclidean(b, c) > 0.02) & (dist.euclidean(a, c) > 0.02)
    return m.where(long).select(
        "event_id", pr.same_point(a, b).alias("same_ab"), F.coalesce(F.when(pr.clockwise(a, b, c), F.lit("right")).when(~pr.clockwise(a, b, c), F.lit("left")), F.lit("none")).alias("side"), pr.point_on_segment(b, line(a, c)).alias("b_on_ac"), pr.clockwise(a, b, c).isNull().alias("collinear"), pr.parallel(F.col("s"), F.col("n")).alias("is_parallel")
    )


# pairs of segments: each move against the move of the event 7 later
_PAIR = fx.with_("fix", "mv") + """, pr AS (SELECT p.event_id, p.ax, p.ay, p.bx, p.by_ AS by_, q.ax AS px, q.ay AS py, q.bx AS qx, q.by_ AS qy
  FROM mv p JOIN mv q ON q.event_id = p.event_id + 7),
 k AS (SELECT *, (bx - ax) * (qy - py) - (by_ - ay) * (qx - px) AS det, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS l1, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS l2 FROM pr),
 uv AS (SELECT *, ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det AS u, ((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) / det AS v FROM k WHERE abs(det) > 0.001) """


@query(
    _PAIR
    + """SELECT event_id, CASE WHEN hit THEN 'Cross' ELSE 'NoCross' END AS status, CASE WHEN hit THEN round(ax + u * (bx - ax), 6) END AS x, CASE WHEN hit THEN round(ay + u * (by_ - ay), 6) END AS y,
  v >= -0.01 / l2 AND v <= 1 + 0.01 / l2 AS line_seg, u >= -0.01 / l1 AND v >= -0.01 / l2 AS ray_ray, u >= -0.01 / l1 AND u <= 1 + 0.01 / l1 AND v >= -0.01 / l2 AS seg_ray
FROM (SELECT *, u >= -0.01 / l1 AND u <= 1 + 0.01 / l1 AND v >= -0.01 / l2 AND v <= 1 + 0.01 / l2 AS hit FROM uv)"""
)
def segment_intersections(spark, sf_dir):
    m = fx.moves(spark, sf_dir).select("event_id", "s")
    pair = m.join(m.select((F.col("event_id") - 7).alias("event_id"), F.col("s").alias("t")), "event_id")
    s, t = F.col("s"), F.col("t")
    det = (s.b.x - s.a.x) * (t.b.y - t.a.y) - (s.b.y - s.a.y) * (t.b.x - t.a.x)
    found = pair.where(F.abs(det) > 0.001).withColumn("r", ix.seg_seg(s, t))
    p = F.col("r.points")[0]
    return found.select("event_id", "r.status", r6(p.x).alias("x"), r6(p.y).alias("y"), pr.line_meets_seg(s, t).alias("line_seg"), pr.ray_meets_ray(s, t).alias("ray_ray"), pr.seg_meets_ray(s, t).alias("seg_ray"))


@query()
def line_intersections(spark, sf_dir):
    m = fx.moves(spark, sf_dir).select("event_id", "s")
    pair = m.join(m.select((F.col("event_id") - 7).alias("event_id"), F.col("s").alias("t")), "event_id")
    s, t = F.col("s"), F.col("t")
    kinds = {"line_line": ix.line_line, "line_ray": ix.line_ray, "seg_line": ix.seg_line, "ray_line": ix.ray_line, "ray_seg": ix.ray_seg, "ray_ray": ix.ray_ray}
    return pair.select("event_id", *(f(s, t)["status"].alias(n) for n, f in kinds.items()))


@query(
    fx.with_("fix", "mv")
    + """, k AS (SELECT *, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) AS sq, (bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay) AS dot FROM mv),
 f AS (SELECT *, ax + dot / sq * (cx - ax) AS fx, ay + dot / sq * (cy - ay) AS fy, dot / sq AS u FROM k WHERE sq > 1)
SELECT event_id, round(abs((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / sqrt(sq), 6) AS to_line,
  round(CASE WHEN u <= 0 THEN sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) WHEN u >= 1 THEN sqrt((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)) ELSE sqrt((fx - bx) * (fx - bx) + (fy - by_) * (fy - by_)) END, 6) AS to_segment,
  round(CASE WHEN dot >= 0 THEN abs((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / sqrt(sq) ELSE sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) END, 6) AS to_ray,
  round(abs(bx - ax) + abs(by_ - ay), 6) AS manhattan, round(fx, 4) AS foot_x, round(fy, 4) AS foot_y FROM f WHERE abs((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) > 0.01"""
)
def point_distances(spark, sf_dir):
    m = fx.moves(spark, sf_dir)
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("n.b")
    base = line(a, c)
    off = F.abs((c.x - a.x) * (b.y - a.y) - (c.y - a.y) * (b.x - a.x)) > 0.01
    m = m.where(off & ((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) > 1))
    foot = dist.foot_on_line(b, base)
    return m.select("event_id", r6(dist.to_line(b, base)).alias("to_line"), r6(dist.to_segment(b, base)).alias("to_segment"), r6(dist.to_ray(b, base)).alias("to_ray"), r6(dist.manhattan(a, b)).alias("manhattan"), F.round(foot.x, 4).alias("foot_x"), F.round(foot.y, 4).alias("foot_y"))


_GEO = "20 + {0} * 0.3::DOUBLE AS {2}a, -120 + {1} * 0.5::DOUBLE AS {2}o"


@query(
    fx.with_("fix", "mv")
    + f""", g AS (SELECT event_id, {_GEO.format('ax', 'ay', 'p')}, {_GEO.format('bx', 'by_', 'q')} FROM mv),
 h AS (SELECT *, pow(sin((radians(qa) - radians(pa)) / 2), 2) + cos(radians(pa)) * cos(radians(qa)) * pow(sin(radians(qo - po) / 2), 2) AS v,
   ln(tan(radians(qa) / 2 + pi() / 4)) - ln(tan(radians(pa) / 2 + pi() / 4)) AS phi, radians(qo) - radians(po) AS dl FROM g)
SELECT event_id, round(2 * 6378137.0::DOUBLE * atan2(sqrt(v), sqrt(1 - v)), 3) AS meters, round(2 * 3958.8::DOUBLE * atan2(sqrt(v), sqrt(1 - v)), 6) AS miles,
  round((degrees(atan2(dl, phi)) + 360) % 360, 4) % 360 AS heading, round(ln(tan(pi() / 4 + radians(pa) / 2)) * 6378137.0::DOUBLE, 3) AS north, round(radians(po) * 6378137.0::DOUBLE, 3) AS east FROM h WHERE pa <> qa OR po <> qo"""
)
def geographic_measures(spark, sf_dir):
    geo = lambda p: pt(20 + p.x * 0.3, -120 + p.y * 0.5)
    m = fx.moves(spark, sf_dir).select("event_id", geo(F.col("s.a")).alias("p"), geo(F.col("s.b")).alias("q"))
    p, q = F.col("p"), F.col("q")
    flat = vec.geographic_to_mercator(p)
    return m.where((p.x != q.x) | (p.y != q.y)).select("event_id", F.round(dist.great_circle(p, q), 3).alias("meters"), r6(dist.great_circle(p, q, "mile")).alias("miles"), (F.round(dist.heading_geographic(p, q), 4) % 360).alias("heading"), F.round(flat.x, 3).alias("north"), F.round(flat.y, 3).alias("east"))


@query(
    fx.with_("fix", "mv")
    + """, v AS (SELECT event_id, bx - ax AS vx, by_ - ay AS vy, cx - bx AS wx, cy - by_ AS wy FROM mv WHERE abs(by_ - ay) > 0.001 AND abs(cy - by_) > 0.001 AND abs(cy - ay) > 0.01),
 d AS (SELECT *, degrees(atan2(vx, vy)) AS d1, degrees(atan2(vx + wx, vy + wy)) AS d2 FROM v)
SELECT event_id, round(sqrt(vx * vx + vy * vy), 6) AS norm, round(CASE WHEN d1 < 0 THEN d1 + 360 ELSE d1 END, 4) AS deg,
  round(sqrt((vx + wx) * (vx + wx) + (vy + wy) * (vy + wy)), 6) AS sum_norm, round(CASE WHEN d2 < 0 THEN d2 + 360 ELSE d2 END, 4) AS sum_deg FROM d WHERE abs(vx + wx) > 0.01"""
)
def polar_vectors(spark, sf_dir):
    m = fx.moves(spark, sf_dir)
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("n.b")
    m = m.where((F.abs(b.y - a.y) > 0.001) & (F.abs(c.y - b.y) > 0.001) & (F.abs(c.y - a.y) > 0.01) & (F.abs((b.x - a.x) + (c.x - b.x)) > 0.01))
    v, w = vec.xy_to_polar(pt(b.x - a.x, b.y - a.y)), vec.xy_to_polar(pt(c.x - b.x, c.y - b.y))
    s = vec.polar_add(v, w)
    return m.select("event_id", r6(v["norm"]).alias("norm"), F.round(v["deg"], 4).alias("deg"), r6(s["norm"]).alias("sum_norm"), F.round(s["deg"], 4).alias("sum_deg"))


@query(
    fx.with_("corner", "edge")
    + """SELECT poly_id, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) AS perimeter,
  round(sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cx, round(sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cy,
  sum(ax * by_ - bx * ay) < 0 AS cw, true AS simple FROM edge GROUP BY poly_id"""
)
def polygon_measures(spark, sf_dir):
    p = F.col("poly")
    c = dist.centroid(p)
    return fx.polygons(spark, sf_dir).select("poly_id", r6(vec.area(p)).alias("area"), r6(vec.perimeter(p)).alias("perimeter"), r6(c.x).alias("cx"), r6(c.y).alias("cy"), vec.is_clockwise(p).alias("cw"), pr.simple_polygon(p).alias("simple"))


@query(
    fx.with_("dep", "corner", "edge")
    + """, c AS (SELECT depot_id, poly_id, sum(CASE WHEN (ay > dep.y) <> (by_ > dep.y) AND dep.x < ax + (dep.y - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
   min(sqrt(pow(dep.x - (ax + least(1, greatest(0, ((dep.x - ax) * (bx - ax) + (dep.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) * (bx - ax)), 2)
     + pow(dep.y - (ay + least(1, greatest(0, ((dep.x - ax) * (bx - ax) + (dep.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) * (by_ - ay)), 2))) AS d
 FROM dep, edge GROUP BY depot_id, poly_id)
SELECT depot_id, poly_id, round(CASE WHEN inside THEN 0 ELSE d END, 5) AS dist FROM c"""
)
def point_polygon_distance(spark, sf_dir):
    return fx.depots(spark, sf_dir).crossJoin(F.broadcast(fx.polygons(spark, sf_dir))).select("depot_id", "poly_id", F.round(dist.to_polygon(F.col("loc"), F.col("poly")), 5).alias("dist"))


@query(
    fx.with_("corner")
    + """, b AS (SELECT poly_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(x) + 8 AS ox, min(y) + 8 AS oy FROM corner GROUP BY poly_id)
SELECT a.poly_id AS p, c.poly_id AS q, greatest(abs(a.ox - c.ox) - 16, 0) = 0 AND greatest(abs(a.oy - c.oy) - 16, 0) = 0 AND abs(a.ox - c.ox) + abs(a.oy - c.oy) <= 24 AS meets
FROM b a, b c WHERE a.poly_id < c.poly_id"""
)
def polygon_pairs(spark, sf_dir):
    # the octagons are congruent, so the SQL twin can use the difference of their centres
    p = fx.polygons(spark, sf_dir)
    a, b = p.select(F.col("poly_id").alias("p"), F.col("poly").alias("r")), p.select(F.col("poly_id").alias("q"), F.col("poly").alias("s"))
    return a.join(b, F.col("p") < F.col("q")).select("p", "q", pr.polygon_meets_polygon(F.col("r"), F.col("s")).alias("meets"))


@query()
def segment_polygon_parts(spark, sf_dir):
    ring = F.col("poly")
    near = spatial.segments_near_polygons(fx.moves(spark, sf_dir).select("event_id", "s"), fx.polygons(spark, sf_dir))
    out = near.select("event_id", "poly_id", F.posexplode(ix.with_polygon("seg", F.col("s"), ring)).alias("part", "r"), F.size(ix.seg_minus_polygon(F.col("s"), ring)).alias("n_outside"))
    return out.select("event_id", "poly_id", "part", "r.type", "r.interior", F.round(dist.euclidean(F.col("r.points")[0], F.element_at("r.points", -1)), 4).alias("way"), "n_outside")


@query(
    fx.with_("fix", "mv")
    + """, c AS (SELECT event_id, bx - ax AS px, by_ - ay AS py, (cx - bx) / 10 AS vx, (cy - by_) / 10 AS vy FROM mv),
 q AS (SELECT *, vx * vx + vy * vy AS sq, least(greatest(CASE WHEN vx * vx + vy * vy > 0 THEN -(px * vx + py * vy) / (vx * vx + vy * vy) ELSE 0 END, 0), 20) AS t FROM c)
SELECT event_id, round(t, 6) AS t, round(sqrt((px + t * vx) * (px + t * vx) + (py + t * vy) * (py + t * vy)), 6) AS dist FROM q WHERE sq > 0.0001"""
)
def closest_approach(spark, sf_dir):
    m = fx.moves(spark, sf_dir)
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("n.b")
    v = pt((c.x - b.x) / 10, (c.y - b.y) / 10)
    got = sq.closest_approach(pt(0, 0), pt(0, 0), pt(b.x - a.x, b.y - a.y), v, F.lit(0.0), F.lit(20.0))
    return m.where(v.x * v.x + v.y * v.y > 0.0001).select("event_id", r6(got["t"]).alias("t"), r6(got["dist"]).alias("dist"))


@query(
    fx.with_("fix", "mv")
    + """, c AS (SELECT event_id, bx - ax AS px, by_ - ay AS py, (cx - bx) / 100 AS vx, (cy - by_) / 100 AS vy FROM mv),
 q AS (SELECT *, vx * vx + vy * vy - 4 AS a, 2 * (px * vx + py * vy) AS b, px * px + py * py AS c FROM c),
 s AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS t FROM q WHERE c > 0.01)
SELECT event_id, round(t, 6) AS t, round(px + vx * t, 5) AS x, round(py + vy * t, 5) AS y FROM s"""
)
def interceptions(spark, sf_dir):
    m = fx.moves(spark, sf_dir)
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("n.b")
    p = pt(b.x - a.x, b.y - a.y)
    got = sq.intercept(pt(0, 0), 2.0, p, pt((c.x - b.x) / 100, (c.y - b.y) / 100))
    return m.where(p.x * p.x + p.y * p.y > 0.01).select("event_id", r6(got["t"]).alias("t"), F.round(got["loc"].x, 5).alias("x"), F.round(got["loc"].y, 5).alias("y"))


@query(
    """WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 173) % 256 AS b FROM part),
 k AS (SELECT *, greatest(r, g, b) + least(r, g, b) AS k FROM c)
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, printf('#%02x%02x%02x', k - r, k - g, k - b) AS complement,
 CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b >= 192 THEN 'black' ELSE 'white' END AS on_it FROM k"""
)
def colours(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_partkey")
    ch = lambda m: (F.col("p_partkey") * m) % 256
    h = vec.rgb_to_hex(ch(37), ch(91), ch(173))
    return p.withColumn("hex", h).select("p_partkey", "hex", vec.complement(F.col("hex")).alias("complement"), vec.text_colour(F.col("hex")).alias("on_it"))


@query(
    fx.with_("dep")
    + """SELECT depot_id, i, round(x + 3 * sin(radians(i * 12.0::DOUBLE)), 6) AS vx, round(y + 3 * cos(radians(i * 12.0::DOUBLE)), 6) AS vy
FROM dep, (SELECT unnest(range(30))::INTEGER AS i)"""
)
def circle_vertices(spark, sf_dir):
    c = fx.depots(spark, sf_dir).select("depot_id", F.posexplode(vec.circle(F.col("loc"), 3.0)).alias("i", "v"))
    return c.select("depot_id", "i", r6(F.col("v.x")).alias("vx"), r6(F.col("v.y")).alias("vy"))


@query()
def geodesic_circles(spark, sf_dir):
    d = fx.depots(spark, sf_dir).withColumn("ring", vec.circle_geographic(20 + F.col("loc.x") * 0.3, -120 + F.col("loc.y") * 0.5, F.lit(1000.0), F.lit(12)))
    return d.select("depot_id", F.size("ring").alias("n"), F.round(vec.area_geographic(F.col("ring")), 1).alias("area"))


@query(
    fx.with_("rp")
    + """, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM rp WINDOW w AS (PARTITION BY road_id ORDER BY pos)),
 d AS (SELECT road_id, pos, x, y, px, py, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS d FROM s),
 m AS (SELECT *, sum(d) OVER (PARTITION BY road_id ORDER BY pos) - d AS done FROM d)
SELECT road_id, round(px + (25 - done) / d * (x - px), 4) AS x, round(py + (25 - done) / d * (y - py), 4) AS y FROM m WHERE d > 0 AND done <= 25 - 1e-7 AND done + d > 25 + 1e-7"""
)
def points_at_mileage(spark, sf_dir):
    r = fx.roads(spark, sf_dir).withColumn("p", dist.at_mileage(F.col("shape"), F.lit(25.0)))
    return r.where("p is not null").select("road_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query()
def trajectory_traces(spark, sf_dir):
    f = fx.fixes(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "loc"))).alias("s"))
    seq = F.transform("s", lambda p: sq.timed(p["loc"], p["t"]))
    t0 = F.element_at("s", 1)["t"]
    f = f.withColumn("seq", seq).withColumn("t0", t0)
    way = sq.trace(F.col("seq"), F.col("t0") + 86400.0, F.col("t0") + 864000.0)
    return f.select("user_id", F.size(way).alias("n_points"), F.round(dist.length(way), 4).alias("way"), sq.valid_timed(F.col("seq")).alias("valid"))


@query()
def timed_routes(spark, sf_dir):
    r = fx.roads(spark, sf_dir).withColumn("clean", sq.remove_degenerate(F.col("shape")))
    timed = sq.to_timed(F.col("clean"), 2.0, 1.0)
    return r.select("road_id", F.size("clean").alias("n_stops"), F.round(F.element_at(timed, -1)["t"], 4).alias("arrival"), sq.mileages_of(F.col("clean"), F.element_at("clean", -1)).alias("at"))


@query(
    """SELECT o_custkey AS cust, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(sum(CASE WHEN flag AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run
FROM (SELECT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AS flag, lag(o_orderkey % 3 <> 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) QUALIFY flag"""
)
def flag_runs(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").cast("long").alias("o_orderkey"), (F.col("o_orderkey") % 3 != 0).alias("flag"))
    return sq.runs_of_flags(o, "cust", "o_orderkey", "flag").select("cust", "o_orderkey", F.col("run").cast("long").alias("run"))


@query("SELECT c_nationkey AS nation, CAST(bin - 1 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(min(c_custkey) AS BIGINT) AS first FROM (SELECT c_nationkey, c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bin FROM customer) GROUP BY 1, 2")
def even_splits(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("long"))).alias("ids"))
    return c.select("nation", F.posexplode(sq.split_even(F.col("ids"), 4)).alias("bin", "part")).where(F.size("part") > 0).select("nation", "bin", F.size("part").cast("long").alias("n"), F.array_min("part").alias("first"))

