"""Shapes derived from the relational tables: points by exact integer arithmetic, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shapes import line, pt

#: Vertex offsets of the octagons around the nations' points, counter-clockwise.
OCTAGON = ((8, 4), (4, 8), (-4, 8), (-8, 4), (-8, -4), (-4, -8), (4, -8), (8, -4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point(key: str, a: int, b: int, o: int) -> Column:
    k = F.col(key).cast("long")
    return pt(((k * a + o) % 10007).cast("double") / F.lit(100.0), ((k * b + o) % 9973).cast("double") / F.lit(100.0))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, nation_id, loc)"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("nation_id"), point("c_custkey", 7919, 104729, 0).alias("loc"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(depot_id, loc)"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("depot_id"), point("s_suppkey", 15485863, 32452843, 17).alias("loc"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, loc, t, ts) of the events"""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", "user_id", point("event_id", 7919, 104729, 5).alias("loc"), t.alias("t"), F.col("ts").cast("timestamp").alias("ts"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, s, n): segment from the event before, and segment to the event after, of one user"""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = fixes(spark, sf_dir).select("event_id", "user_id", "loc", F.lag("loc").over(w).alias("p"), F.lead("loc").over(w).alias("q"))
    return f.where("p is not null and q is not null").select("event_id", "user_id", line(F.col("p"), F.col("loc")).alias("s"), line(F.col("loc"), F.col("q")).alias("n"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, poly): an octagon for each nation"""
    c = point("n_nationkey", 7919, 104729, 900)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), F.array(*(pt(c.x + dx, c.y + dy) for dx, dy in OCTAGON)).alias("poly"))


def road_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(road_id, pos, loc): depot points of an order's lines, in a total order"""
    p = point("l_suppkey", 15485863, 32452843, 17)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("road_id"), "l_linenumber", p.alias("loc"), F.col("l_suppkey"))
    w = Window.partitionBy("road_id").orderBy("l_linenumber", "loc.x", "loc.y")
    return rows.select("road_id", F.row_number().over(w).cast("long").alias("pos"), "loc", "l_suppkey")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(road_id, shape)"""
    rows = road_points(spark, sf_dir).groupBy("road_id").agg(F.array_sort(F.collect_list(F.struct("pos", "loc"))).alias("p"))
    return rows.select("road_id", F.transform("p", lambda x: x["loc"]).alias("shape"))


def lattice(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """(id, a, b, c, d): four points on a 5 x 5 lattice, so that many are equal, collinear or parallel; a and b differ, c and d differ"""
    h = (F.col(key).cast("long") * 7919 + 13) % 390625
    digit = lambda i: F.floor(h / 5**i) % 5
    df = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), *(pt(digit(2 * i), digit(2 * i + 1)).alias(c) for i, c in enumerate("abcd")))
    return df.where((F.col("a") != F.col("b")) & (F.col("c") != F.col("d")))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, region_id, poly): a rectangle with whole corners for each nation, counter-clockwise"""
    k = F.col("n_nationkey").cast("long")
    x0, y0 = k * 7 % 20, k * 11 % 20
    x1, y1 = x0 + 3 + k % 5, y0 + 3 + k * 3 % 6
    return table(spark, sf_dir, "nation").select(k.alias("poly_id"), F.col("n_regionkey").cast("long").alias("region_id"), F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)).alias("poly"))


def instances(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """(instance_id, node_id, x, y, price, demand, lo, hi, service_time): all customers, one instance a nation.

    most: each nation is cut into instances of so many customers in the order of
    their ids, for solvers that take small instances only.
    """
    c = customers(spark, sf_dir)
    k = F.col("node_id")
    lo = ((k * 37) % 500).cast("double")
    df = c.select(F.col("nation_id").cast("long").alias("instance_id"), k.cast("long").alias("node_id"), F.col("loc.x").alias("x"), F.col("loc.y").alias("y"), (1 + k % 17).cast("double").alias("price"), (1 + k % 7).cast("double").alias("demand"), lo.alias("lo"), (lo + 100 + (k * 53) % 200).alias("hi"), (1 + k % 5).cast("double").alias("service_time"))
    if most is None:
        return df
    w = Window.partitionBy("instance_id").orderBy("node_id")
    part = F.floor((F.row_number().over(w) - 1) / most)
    return df.withColumn("_part", part).withColumn("instance_id", F.col("instance_id") * 1_000_000 + F.col("_part")).drop("_part")


#: The same shapes in DuckDB, as CTEs.
def sql_point(key: str, a: int, b: int, o: int) -> tuple[str, str]:
    k = f"CAST({key} AS BIGINT)"
    return f"(CAST(({k} * {a} + {o}) % 10007 AS DOUBLE) / 100.0::DOUBLE)", f"(CAST(({k} * {b} + {o}) % 9973 AS DOUBLE) / 100.0::DOUBLE)"


def _cte() -> dict[str, str]:
    cx, cy = sql_point("c_custkey", 7919, 104729, 0)
    sx, sy = sql_point("s_suppkey", 15485863, 32452843, 17)
    lx, ly = sql_point("l_suppkey", 15485863, 32452843, 17)
    ex, ey = sql_point("event_id", 7919, 104729, 5)
    nx, ny = sql_point("n_nationkey", 7919, 104729, 900)
    corners = ", ".join(f"({i + 1}, {dx}, {dy})" for i, (dx, dy) in enumerate(OCTAGON))
    digit = ", ".join(f"CAST(h // {5 ** (2 * i + j)} % 5 AS DOUBLE) AS {c}{a}" for i, c in enumerate("abcd") for j, a in enumerate("xy"))
    lattice = "SELECT * FROM (SELECT id, {0} FROM (SELECT CAST({1} AS BIGINT) AS id, (CAST({1} AS BIGINT) * 7919 + 13) % 390625 AS h FROM {2})) WHERE (ax <> bx OR ay <> by) AND (cx <> dx OR cy <> dy)"
    digit = digit.replace(" AS by", ' AS "by"')
    lattice = lattice.replace("<> by", '<> "by"')
    return {
        "lat": lattice.format(digit, "o_orderkey", "orders"),
        "lac": lattice.format(digit, "c_custkey", "customer"),
        "rect": "SELECT k AS poly_id, region_id, CAST(k * 7 % 20 AS DOUBLE) AS x0, CAST(k * 7 % 20 + 3 + k % 5 AS DOUBLE) AS x1, CAST(k * 11 % 20 AS DOUBLE) AS y0, CAST(k * 11 % 20 + 3 + k * 3 % 6 AS DOUBLE) AS y1 FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS region_id FROM nation)",
        "cust": f"SELECT c_custkey AS node_id, c_nationkey AS nation_id, {cx} AS x, {cy} AS y FROM customer",
        "dep": f"SELECT s_suppkey AS depot_id, {sx} AS x, {sy} AS y FROM supplier",
        "fix": f"SELECT event_id, user_id, {ex} AS x, {ey} AS y, epoch_us(ts) / 1e6::DOUBLE AS t, ts FROM events",
        "mv": "SELECT * FROM (SELECT event_id, user_id, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM fix WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE ax IS NOT NULL AND cx IS NOT NULL",
        "corner": f"SELECT n_nationkey AS poly_id, v.i, {nx} + v.dx AS x, {ny} + v.dy AS y FROM nation, (VALUES {corners}) AS v(i, dx, dy)",
        "edge": "SELECT poly_id, i, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM corner WINDOW w AS (PARTITION BY poly_id ORDER BY i)",
        "rp": f"SELECT l_orderkey AS road_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {lx}, {ly}) AS pos, {lx} AS x, {ly} AS y, l_suppkey FROM lineitem",
    }


CTE = _cte()


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " "
