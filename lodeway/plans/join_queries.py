"""Queries on joins, rankings, aggregations, trajectories and structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.shapes import pt
from ..operators import aggregates, generators, pairs, ranking, spatial, structures, trajectories
from ..sources import readers
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


@query(
    fx.with_("cust", "dep")
    + """SELECT node_id, depot_id, dist, CAST(1 AS INTEGER) AS rank FROM (SELECT node_id, depot_id, sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)) AS dist,
  row_number() OVER (PARTITION BY node_id ORDER BY sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)), depot_id) AS n FROM cust, dep) WHERE n = 1"""
)
def nearest_depot(spark, sf_dir):
    return pairs.nearest(fx.customers(spark, sf_dir), fx.depots(spark, sf_dir), "node_id", "depot_id")


@query(
    fx.with_("cust", "dep")
    + """SELECT node_id, depot_id, dist, CAST(n AS INTEGER) AS rank FROM (SELECT node_id, depot_id, sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)) AS dist,
  row_number() OVER (PARTITION BY node_id ORDER BY sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)), depot_id) AS n FROM cust, dep) WHERE n <= 3"""
)
def nearest_depots_k(spark, sf_dir):
    return pairs.nearest(fx.customers(spark, sf_dir), fx.depots(spark, sf_dir), "node_id", "depot_id", k=3)


_PAIRS = "SELECT a.nation_id AS instance_id, a.node_id AS src, b.node_id AS dst, {0} AS dist FROM cust a JOIN cust b ON a.nation_id = b.nation_id"


@query(fx.with_("cust") + _PAIRS.format("sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"))
def distance_table_euclidean(spark, sf_dir):
    return pairs.distance_table(fx.customers(spark, sf_dir), "Euclidean", group="nation_id")


@query(fx.with_("cust") + _PAIRS.format("abs(a.x - b.x) + abs(a.y - b.y)"))
def distance_table_manhattan(spark, sf_dir):
    return pairs.distance_table(fx.customers(spark, sf_dir), "Manhattan", group="nation_id")


@query(
    fx.with_("cust")
    + """, g AS (SELECT nation_id, node_id, 20 + x * 0.3::DOUBLE AS la, -120 + y * 0.5::DOUBLE AS lo FROM cust),
 p AS (SELECT a.nation_id AS instance_id, a.node_id AS src, b.node_id AS dst, pow(sin((radians(b.la) - radians(a.la)) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2) AS v FROM g a JOIN g b ON a.nation_id = b.nation_id)
SELECT instance_id, src, dst, round(2 * 6378137.0::DOUBLE * atan2(sqrt(v), sqrt(1 - v)), 3) AS dist FROM p"""
)
def distance_table_geographic(spark, sf_dir):
    c = fx.customers(spark, sf_dir).withColumn("loc", pt(20 + F.col("loc.x") * 0.3, -120 + F.col("loc.y") * 0.5))
    # rounded as SQL does it, on the double; F.round makes a decimal of each
    return pairs.distance_table(c, "LatLon", group="nation_id").withColumn("dist", F.floor(F.col("dist") * 1000 + 0.5) / 1000)


@query(fx.with_("cust") + ", t AS (" + _PAIRS.format("abs(a.x - b.x) * 2 + abs(a.y - b.y)") + ") SELECT instance_id, src, dst, CASE WHEN src = dst THEN 0 ELSE dist END AS dist FROM t")
def distance_table_lookup(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    tau = pairs.table_rows(c, lambda x, y, xs, ys: abs(x - xs) * 2 + abs(y - ys), group="nation_id")
    return pairs.distance_table(c, "Dictionary", group="nation_id", table=tau).select("instance_id", "src", "dst", "dist")


@query()
def distance_table_grid(spark, sf_dir):
    barriers = [(c, r) for c in range(20) for r in range(20) if (c * 7 + r * 13) % 5 == 0]
    c = fx.customers(spark, sf_dir).withColumn("loc", pt(F.floor(F.col("loc.x") / 5.01), F.floor(F.col("loc.y") / 5.01)))
    return pairs.distance_table(c, "Grid", group="nation_id", column=20, row=20, barriers=barriers)


@query()
def distance_table_obstacles(spark, sf_dir):
    walls = [[(30, 30), (60, 30), (60, 60), (30, 60)], [(70, 10), (90, 10), (80, 40)]]
    return pairs.distance_table(fx.customers(spark, sf_dir), "EuclideanBarrier", group="nation_id", polygons=walls).withColumn("dist", F.round("dist", 6))


@query(fx.with_("cust") + "SELECT node_id AS dst, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) AS dist, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) AS rev_dist FROM cust")
def distance_vector(spark, sf_dir):
    return pairs.distance_vector(fx.customers(spark, sf_dir), 50.0, 50.0)


@query(fx.with_("cust", "dep") + "SELECT node_id, nation_id, depot_id, sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)) AS dist FROM cust, dep WHERE sqrt((cust.x - dep.x) * (cust.x - dep.x) + (cust.y - dep.y) * (cust.y - dep.y)) <= 5")
def isochrone_cell_join(spark, sf_dir):
    return pairs.within_distance(fx.customers(spark, sf_dir), fx.depots(spark, sf_dir), 5.0).select("node_id", "nation_id", "depot_id", "dist")


@query(fx.with_("cust") + "SELECT node_id, nation_id, sqrt((x - 40) * (x - 40) + (y - 60) * (y - 60)) AS dist FROM cust WHERE sqrt((x - 40) * (x - 40) + (y - 60) * (y - 60)) <= 20")
def isochrone_one(spark, sf_dir):
    return ranking.isochrone(fx.customers(spark, sf_dir), pt(40.0, 60.0), 20.0).select("node_id", "nation_id", "dist")


@query(fx.with_("cust") + "SELECT node_id, nation_id, dist, CAST(row_number() OVER (PARTITION BY nation_id ORDER BY dist, node_id) AS INTEGER) AS seq FROM (SELECT node_id, nation_id, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) AS dist FROM cust)")
def nodes_by_distance(spark, sf_dir):
    return ranking.by_distance(fx.customers(spark, sf_dir), pt(50.0, 50.0), group=["nation_id"]).select("node_id", "nation_id", "dist", "seq")


@query(
    fx.with_("cust")
    + """, a AS (SELECT *, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) AS d, degrees(atan2(x - 50, y - 50)) AS g FROM cust),
 b AS (SELECT *, CASE WHEN g < 0 THEN g + 360 ELSE g END AS deg FROM a)
SELECT node_id, nation_id, round(deg, 4) AS deg, CAST(row_number() OVER (PARTITION BY nation_id ORDER BY deg, d, node_id) AS INTEGER) AS seq FROM b"""
)
def nodes_by_bearing(spark, sf_dir):
    out = ranking.by_bearing(fx.customers(spark, sf_dir), pt(50.0, 50.0), group=["nation_id"], at_ref=0.0)
    return out.select("node_id", "nation_id", F.round("deg", 4).alias("deg"), "seq")


@query(fx.with_("cust") + "SELECT arg_min(node_id, {'d': sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)), 'n': node_id}) AS node_id, min(sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50))) AS dist FROM cust")
def nearest_node(spark, sf_dir):
    return ranking.nearest_node(fx.customers(spark, sf_dir), pt(50.0, 50.0))


@query(
    fx.with_("cust")
    + """SELECT nation_id, round(min(x) - (max(x) - min(x)) * 0.1, 6) AS x_min, round(max(x) + (max(x) - min(x)) * 0.1, 6) AS x_max,
  round(min(y) - (max(y) - min(y)) * 0.1, 6) AS y_min, round(max(y) + (max(y) - min(y)) * 0.1, 6) AS y_max FROM cust GROUP BY nation_id"""
)
def bounding_boxes(spark, sf_dir):
    p = fx.customers(spark, sf_dir).select("nation_id", F.col("loc.x").alias("x"), F.col("loc.y").alias("y"))
    box = aggregates.bounding_box(p, group=["nation_id"])
    return box.select("nation_id", *(F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))


@query(
    fx.with_("fix", "corner", "edge")
    + """SELECT event_id, poly_id FROM fix, edge GROUP BY event_id, poly_id
HAVING sum(CASE WHEN (ay > fix.y) <> (by_ > fix.y) AND fix.x < ax + (fix.y - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1"""
)
def pt_in_poly_join(spark, sf_dir):
    return spatial.points_in_polygons(fx.fixes(spark, sf_dir).select("event_id", "loc"), fx.polygons(spark, sf_dir)).select("event_id", "poly_id")


@query(
    fx.with_("corner")
    + """, b AS (SELECT poly_id, min(x) + 8 AS ox, min(y) + 8 AS oy FROM corner GROUP BY poly_id)
SELECT a.poly_id AS p, c.poly_id AS q FROM b a, b c WHERE a.poly_id < c.poly_id AND abs(a.ox - c.ox) <= 16 AND abs(a.oy - c.oy) <= 16 AND abs(a.ox - c.ox) + abs(a.oy - c.oy) <= 24"""
)
def polygon_overlap_join(spark, sf_dir):
    p = fx.polygons(spark, sf_dir)
    out = spatial.polygon_overlaps(p.select(F.col("poly_id").alias("p"), "poly"), p.select(F.col("poly_id").alias("q"), "poly"), "p", "q")
    return out.where("p < q")


@query(
    fx.with_("rp")
    + """, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM rp WINDOW w AS (PARTITION BY road_id ORDER BY pos)),
 d AS (SELECT road_id, pos, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS d FROM s)
SELECT road_id, pos, round(sum(d) OVER (PARTITION BY road_id ORDER BY pos), 6) AS mileage FROM d"""
)
def route_mileage(spark, sf_dir):
    p = fx.road_points(spark, sf_dir).select("road_id", "pos", F.col("loc.x").alias("x"), F.col("loc.y").alias("y"))
    return trajectories.with_mileage(p, ["road_id"], ["pos"]).select("road_id", "pos", F.round("mileage", 6).alias("mileage"))


@query(
    fx.with_("rp")
    + """, s AS (SELECT *, CASE WHEN abs(x - lag(x) OVER w) >= 0.01 OR abs(y - lag(y) OVER w) >= 0.01 OR lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS moved FROM rp WINDOW w AS (PARTITION BY road_id ORDER BY pos)),
 i AS (SELECT *, sum(moved) OVER (PARTITION BY road_id ORDER BY pos) AS island FROM s)
SELECT road_id, min(pos) AS pos, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n_rows FROM i GROUP BY road_id, island"""
)
def collapsed_stops(spark, sf_dir):
    p = fx.road_points(spark, sf_dir).select("road_id", "pos", F.col("loc.x").alias("x"), F.col("loc.y").alias("y"))
    return trajectories.collapse_repeats(p, ["road_id"], ["pos"]).select("road_id", "pos", F.col("island").cast("long").alias("island"), "n_rows")


@query(
    fx.with_("fix")
    + """, q AS (SELECT DISTINCT user_id, 1704067200.0::DOUBLE + k * 43200.0::DOUBLE AS at_ FROM fix, (SELECT unnest(range(60)) AS k)),
 p AS (SELECT q.user_id, q.at_, f.t, f.x, f.y FROM q ASOF LEFT JOIN fix f ON q.user_id = f.user_id AND q.at_ >= f.t),
 n AS (SELECT q.user_id, q.at_, f.t, f.x, f.y FROM q ASOF LEFT JOIN fix f ON q.user_id = f.user_id AND q.at_ < f.t)
SELECT p.user_id, p.at_ AS "at", round(CASE WHEN p.t IS NOT NULL AND n.t IS NOT NULL THEN p.x + (p.at_ - p.t) / (n.t - p.t) * (n.x - p.x) ELSE coalesce(p.x, n.x) END, 5) AS x,
 round(CASE WHEN p.t IS NOT NULL AND n.t IS NOT NULL THEN p.y + (p.at_ - p.t) / (n.t - p.t) * (n.y - p.y) ELSE coalesce(p.y, n.y) END, 5) AS y,
 round(CASE WHEN p.t IS NOT NULL AND n.t IS NOT NULL THEN sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) / (n.t - p.t) ELSE 0 END, 8) AS speed FROM p JOIN n USING (user_id, at_)"""
)
def snap_as_of(spark, sf_dir):
    f = fx.fixes(spark, sf_dir).select("user_id", "t", F.col("loc.x").alias("x"), F.col("loc.y").alias("y"))
    asks = f.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("user_id", (F.lit(1704067200.0) + F.col("k") * 43200.0).alias("at"))
    out = trajectories.snap_at(f, asks, "user_id")
    return out.select("user_id", "at", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("speed", 8).alias("speed"))


_WIN = "SELECT c_custkey % 50 AS grp, CAST((c_custkey * 37) % 500 AS DOUBLE) AS lo, CAST((c_custkey * 37) % 500 + 5 + (c_custkey * 53) % 20 AS DOUBLE) AS hi FROM customer"


@query(
    f"""WITH w AS ({_WIN}), a AS (SELECT g AS grp, CAST(t AS DOUBLE) AS t FROM (SELECT unnest(range(50))::BIGINT AS g), (SELECT unnest(range(0, 520, 13)) AS t))
SELECT a.grp, a.t, CASE WHEN bool_or(w.lo <= a.t AND a.t <= w.hi) THEN a.t ELSE min(CASE WHEN w.lo > a.t THEN w.lo END) END AS earliest FROM a LEFT JOIN w ON a.grp = w.grp GROUP BY a.grp, a.t"""
)
def earliest_available(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    lo = ((k * 37) % 500).cast("double")
    w = fx.table(spark, sf_dir, "customer").select((k % 50).alias("grp"), lo.alias("lo"), (lo + 5 + (k * 53) % 20).alias("hi"))
    asks = spark.range(50).select(F.col("id").alias("grp"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(519), F.lit(13)), lambda v: v.cast("double"))).alias("t"))
    return trajectories.available(w, asks, "grp")


@query(
    """WITH c AS (SELECT c_custkey AS a, CAST((c_custkey * 37) % 500 AS DOUBLE) AS lo1, CAST((c_custkey * 37) % 500 + 5 + (c_custkey * 53) % 20 AS DOUBLE) AS hi1 FROM customer),
 s AS (SELECT s_suppkey AS b, CAST((s_suppkey * 71) % 500 AS DOUBLE) AS lo2, CAST((s_suppkey * 71) % 500 + 3 + (s_suppkey * 29) % 40 AS DOUBLE) AS hi2 FROM supplier)
SELECT a, b FROM c JOIN s ON greatest(lo1, lo2) <= least(hi1, hi2)"""
)
def overlapping_intervals(spark, sf_dir):
    k, s = F.col("c_custkey").cast("long"), F.col("s_suppkey").cast("long")
    lo1, lo2 = ((k * 37) % 500).cast("double"), ((s * 71) % 500).cast("double")
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), lo1.alias("lo1"), (lo1 + 5 + (k * 53) % 20).alias("hi1"))
    p = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), lo2.alias("lo2"), (lo2 + 3 + (s * 29) % 40).alias("hi2"))
    return trajectories.overlapping(c, p, "lo1", "hi1", "lo2", "hi2", 50.0).select("a", "b")


@query(
    """WITH c AS (SELECT c_custkey AS a, CAST((c_custkey * 37) % 500 AS DOUBLE) AS lo, CAST((c_custkey * 37) % 500 + 5 + (c_custkey * 53) % 20 AS DOUBLE) AS hi FROM customer)
SELECT a, s_suppkey AS b FROM c JOIN supplier ON CAST((s_suppkey * 71) % 500 AS DOUBLE) BETWEEN lo AND hi"""
)
def stabbed_intervals(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    lo = ((k * 37) % 500).cast("double")
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), lo.alias("lo"), (lo + 5 + (k * 53) % 20).alias("hi"))
    p = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), ((F.col("s_suppkey").cast("long") * 71) % 500).cast("double").alias("at"))
    return trajectories.stabbing(c, p, "lo", "hi", "at", 50.0).select("a", "b")


@query(
    fx.with_("dep", "rp")
    + """, n AS (SELECT road_id, pos, l_suppkey AS src, coalesce(lead(l_suppkey) OVER w, first_value(l_suppkey) OVER w) AS dst FROM rp WINDOW w AS (PARTITION BY road_id ORDER BY pos)),
 t AS (SELECT a.depot_id AS src, b.depot_id AS dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM dep a, dep b)
SELECT road_id, round(sum(d), 5) AS dist, round(sum(d), 5) AS rev_dist FROM n JOIN t USING (src, dst) GROUP BY road_id"""
)
def closed_route_costs(spark, sf_dir):
    r = fx.road_points(spark, sf_dir).groupBy(F.col("road_id").alias("route_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "l_suppkey"))).alias("p"))
    r = r.select("route_id", F.transform("p", lambda x: x["l_suppkey"]).alias("seq"))
    out = structures.route_lengths(r, fx.depots(spark, sf_dir), node="depot_id")
    return out.select(F.col("route_id").alias("road_id"), F.round("dist", 5).alias("dist"), F.round("rev_dist", 5).alias("rev_dist"))


@query(
    """WITH RECURSIVE t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS parent FROM nation),
 w AS (SELECT id, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.id, level + 1 FROM t JOIN w ON t.parent = w.id)
SELECT CAST(id AS BIGINT) AS id, CAST(level AS INTEGER) AS level, id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS is_leaf FROM w"""
)
def tree_levels(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    t = fx.table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent"))
    leaf = structures.leaves(t).select("id", F.lit(True).alias("is_leaf"))
    return structures.levels(t).select("id", "level").join(leaf, "id", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))


@query(
    """WITH j AS (SELECT o_custkey AS cust, o_orderkey, 1 + o_orderkey % 5 AS len FROM orders)
SELECT cust, CAST(o_orderkey AS BIGINT) AS id, CAST(sum(len) OVER w - len AS DOUBLE) AS ts, CAST(sum(len) OVER w AS DOUBLE) AS te FROM j WINDOW w AS (PARTITION BY cust ORDER BY o_orderkey)"""
)
def schedules(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    job = F.struct(k.alias("id"), (1 + k % 5).cast("double").alias("length"), F.array().cast("array<struct<lo:double,hi:double>>").alias("windows"))
    o = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    return o.select("cust", F.explode(structures.schedule(F.col("jobs"))).alias("j")).select("cust", "j.id", "j.ts", "j.te")


@query(
    """SELECT CAST((r_regionkey + 11) * 10000 + (n_nationkey + 1) * 100 AS BIGINT) AS adcode, r_name AS province, n_name AS city, CAST(NULL AS VARCHAR) AS district
FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def region_lookup(spark, sf_dir):
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    code = ((F.col("n_regionkey") + 11) * 10000 + (F.col("n_nationkey") + 1) * 100).cast("long")
    names = n.select(code.alias("adcode"), F.col("n_name").alias("name")).unionByName(r.select(((F.col("r_regionkey") + 11) * 10000).cast("long").alias("adcode"), F.col("r_name").alias("name")))
    return readers.region_names(n.select(code.alias("adcode")), names)


@query()
def polygon_unions(spark, sf_dir):
    p = fx.polygons(spark, sf_dir).withColumn("g", F.col("poly_id") % 5)
    out = aggregates.polygon_union(p, "g", key="poly_id")
    from ..functions.vectors import area

    return out.select("group_id", "part", F.round(area(F.col("poly")), 4).alias("area"))


@query()
def polygon_differences(spark, sf_dir):
    p = fx.polygons(spark, sf_dir).withColumn("g", F.col("poly_id") % 5)
    out = aggregates.polygon_difference(p.where("poly_id < 10"), p.where("poly_id >= 10"), "g")
    from ..functions.vectors import area

    return out.select("group_id", "part", F.round(area(F.col("poly")), 4).alias("area"))


@query()
def polygon_visibility(spark, sf_dir):
    return spatial.visibility(fx.polygons(spark, sf_dir))


@query()
def route_polygon_events(spark, sf_dir):
    r = fx.roads(spark, sf_dir).where("size(shape) > 1")
    e = spatial.polygon_events(r, fx.polygons(spark, sf_dir), "road_id", "poly_id", "shape")
    return e.select("road_id", "poly_id", F.round("mileage", 4).alias("mileage"), "event")


@query()
def route_pieces(spark, sf_dir):
    r = fx.roads(spark, sf_dir).where("size(shape) > 1")
    e = spatial.polygon_events(r, fx.polygons(spark, sf_dir), "road_id", "poly_id", "shape")
    p = spatial.label_pieces(e, r, "road_id", "poly_id", "shape")
    return p.select("road_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.concat_ws(",", F.col("polygons").cast("array<string>")).alias("polygons"))


@query()
def clipped_roads(spark, sf_dir):
    r = fx.roads(spark, sf_dir).where("size(shape) > 1")
    from ..functions.distances import length

    out = spatial.clip_roads(r, fx.polygons(spark, sf_dir))
    return out.select("road_id", "poly_id", "part", F.round(length(F.col("shape")), 4).alias("way"))


def _generated(name: str, make) -> None:
    QUERIES[name] = make


_generated("generated_points", lambda spark, sf_dir: generators.locations(spark, 1000, "UniformSquareXY", 3))
_generated("generated_points_in_polygon", lambda spark, sf_dir: generators.locations(spark, 1000, "UniformPolyXY", 3, poly=[(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]))
_generated("generated_points_outside", lambda spark, sf_dir: generators.locations(spark, 1000, "UniformAvoidPolyXY", 3, poly=[(20, 20), (80, 20), (80, 80), (20, 80)]))
_generated("generated_points_in_circle", lambda spark, sf_dir: generators.locations(spark, 1000, "UniformCircleXY", 3, center=(50, 50), radius=10))
_generated("generated_points_on_roads", lambda spark, sf_dir: generators.locations(spark, 1000, "RoadNetwork", 3, roads=fx.roads(spark, sf_dir)))
_generated("generated_polygons", lambda spark, sf_dir: generators.polygons(spark, 10, 3, "RndConvexPoly", overlap=False, min_radius=4.0, max_radius=8.0))
_generated("generated_arcs", lambda spark, sf_dir: generators.arc_neighbourhoods(generators.arcs(spark, 100, 3), 1.0))
_generated("weighted_picks", lambda spark, sf_dir: generators.weighted_pick(fx.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("w")), spark.range(1000).withColumnRenamed("id", "draw"), "w", "n_nationkey", 5))
_generated("list_helpers", lambda spark, sf_dir: fx.instances(spark, sf_dir).groupBy("instance_id").agg(F.array_sort(F.collect_list("node_id")).alias("ids")).select("instance_id", sq.list_text(F.col("ids")).alias("text"), F.size(sq.true_runs(F.col("ids"), F.transform("ids", lambda i: i % 3 != 0))).alias("n_runs"), sq.rule_line("ids").alias("rule")))
