"""Seeded random instances: every row is a function of its id and the seed, so reruns agree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyError, MissingParameterError, SolverNotAvailableError, UnsupportedInputError
from ..functions.distances import at_bearing, at_bearing_geographic, at_mileage, distance, length, vincenty_direct
from ..functions.shapes import POLY, POLY_TYPE, poly, pt, unit
from ..solvers import overlay
from .aggregates import running_sum
from .spatial import clip_roads


def _need(options: dict, *names: str) -> list:
    missing = [n for n in names if n not in options]
    if missing:
        raise MissingParameterError(f"missing {', '.join(missing)}")
    return [options[n] for n in names]


def square(i: Column, seed: int, x: tuple[float, float], y: tuple[float, float]) -> Column:
    return pt(x[0] + (x[1] - x[0]) * unit(seed, i, F.lit("x")), y[0] + (y[1] - y[0]) * unit(seed, i, F.lit("y")))


def disk(i: Column, seed: int, center: tuple[float, float], radius: float) -> Column:
    r, t = F.sqrt(unit(seed, i, F.lit("r"))) * radius, unit(seed, i, F.lit("t")) * (2 * math.pi)
    return pt(center[0] + r * F.cos(t), center[1] + r * F.sin(t))


def triangle(i: Column, seed: int, a: Column, b: Column, c: Column) -> Column:
    """Uniform in a triangle."""
    s, v = F.sqrt(unit(seed, i, F.lit("s"))), unit(seed, i, F.lit("v"))
    mix = lambda f: (1 - s) * f(a) + s * (1 - v) * f(b) + s * v * f(c)
    return pt(mix(lambda p: p.x), mix(lambda p: p.y))


def _in_polygons(df: DataFrame, seed: int, rings: list) -> DataFrame:
    """Uniform over the area of polygons."""
    return _in_triangles(df, seed, [t for r in rings for t in overlay.triangles([tuple(map(float, p)) for p in r])])


def _in_triangles(df: DataFrame, seed: int, parts: list) -> DataFrame:
    """Uniform over the area of triangles that don't overlap: one by its share of area, then a point in it."""
    sizes = np.cumsum([abs(overlay.signed_area(t)) for t in parts])
    edges = (sizes / sizes[-1]).tolist()
    pick = F.lit(len(parts) - 1)
    u = F.col("_u")
    for k in range(len(parts) - 2, -1, -1):
        pick = F.when(u < edges[k], F.lit(k)).otherwise(pick)
    table = F.array(*(poly(t) for t in parts))
    out = df.withColumn("_u", unit(seed, "node_id", F.lit("tri"))).withColumn("_t", F.element_at(table, pick + 1))
    return out.withColumn("loc", triangle(F.col("node_id"), seed, F.col("_t")[0], F.col("_t")[1], F.col("_t")[2])).drop("_u", "_t")


def locations(spark: SparkSession, n: int, distr: str = "UniformSquareXY", seed: int = 0, roads: DataFrame | None = None, **o) -> DataFrame:
    """(node_id, loc) of n random locations.

    On roads (columns road_id, shape, class), options: classes that count, and
    for the kinds in a polygon or circle the roads are clipped to it first.
    """
    df = spark.range(n).withColumnRenamed("id", "node_id")
    i = F.col("node_id")
    if distr == "UniformSquareXY":
        return df.withColumn("loc", square(i, seed, o.get("x_range", (0, 100)), o.get("y_range", (0, 100))))
    if distr == "UniformCubeXYZ":
        z = o.get("z_range", (0, 100))
        p = square(i, seed, o.get("x_range", (0, 100)), o.get("y_range", (0, 100)))
        return df.withColumn("loc", F.struct(p["x"].alias("x"), p["y"].alias("y"), (z[0] + (z[1] - z[0]) * unit(seed, i, F.lit("z"))).alias("z")))
    if distr == "UniformPolyXY":
        return _in_polygons(df, seed, o["polys"] if "polys" in o else _need(o, "poly"))
    if distr == "UniformAvoidPolyXY":
        rings = [[tuple(map(float, p)) for p in r] for r in (o["polys"] if "polys" in o else _need(o, "poly"))]
        free = overlay.free_triangles((*map(float, o.get("x_range", (0, 100))), *map(float, o.get("y_range", (0, 100)))), rings)
        if not free:
            raise EmptyError("the polygons leave no room")
        return _in_triangles(df, seed, free)
    if distr == "UniformCircleXY":
        center, radius = _need(o, "center", "radius")
        return df.withColumn("loc", disk(i, seed, center, radius))
    if distr == "UniformCircleLatLon":
        center, radius = _need(o, "center", "radius")
        deg, way = unit(seed, i, F.lit("t")) * 360.0, F.sqrt(unit(seed, i, F.lit("r"))) * float(radius)
        return df.withColumn("loc", at_bearing_geographic(F.lit(float(center[0])), F.lit(float(center[1])), deg, way))
    if distr in ("RoadNetworkPolyLatLon", "RoadNetworkCircleLatLon", "RoadNetwork"):
        if roads is None:
            raise MissingParameterError("missing roads")
        if "classes" in o:
            roads = roads.where(F.col("class").isin(list(o["classes"])))
        area = None
        if distr == "RoadNetworkPolyLatLon":
            area = o["polys"] if "polys" in o else _need(o, "poly")
        elif distr == "RoadNetworkCircleLatLon":
            center, radius = _need(o, "center", "radius")
            deg = np.arange(60) * 6.0
            area = [list(zip(*(v.tolist() for v in vincenty_direct(np.full(60, float(center[0])), np.full(60, float(center[1])), deg, np.full(60, float(radius)))), strict=True))]
        if area is not None:
            rings = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(area)], f"poly_id long, poly {POLY}")
            part = F.struct("road_id", "poly_id", "part").alias("road_id")
            roads = clip_roads(roads.select("road_id", "shape"), rings, cell=o.get("cell", 1.0)).select(part, "shape")
        return on_roads(df, roads, seed)
    if distr == "UniformPolyLatLon":
        raise SolverNotAvailableError("uniform points in a geographic polygon are not available")
    raise UnsupportedInputError(f"unknown distribution {distr}")


def on_roads(df: DataFrame, roads: DataFrame, seed: int = 0, key: str = "road_id", shape: str = "shape") -> DataFrame:
    """Points on roads (already clipped and filtered), a road by its share of length."""
    sized = roads.select(F.col(key).alias("road_id"), F.col(shape).alias("shape"), length(F.col(shape)).alias("len")).where("len > 0")
    out = _by_share(df, sized, "len", "road_id", unit(seed, "node_id", F.lit("road")))
    return out.select("node_id", "road_id", at_mileage(F.col("shape"), F.col("_s") - F.col("_lo")).alias("loc"))


def _by_share(draws: DataFrame, items: DataFrame, weight: str, key: str, u: Column) -> DataFrame:
    """Each draw with the item in whose interval it falls, `_lo` where that begins and `_s` where the draw lies.

    Running sums make each item an interval; draws and intervals meet in about as
    many buckets of equal width as there are items, so a bucket holds few.
    """
    cum = running_sum(items.withColumn("_w", F.col(weight).cast("double")), [key], "_w", "_lo").withColumn("_hi", F.col("_lo") + F.col("_w"))
    total, n = cum.agg(F.max("_hi"), F.count("*")).first()
    width = max((total or 0.0) / max(n, 16), 1e-9)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    cum = cum.withColumn("_b", F.explode(F.sequence(bucket("_lo"), bucket("_hi"))))
    asked = draws.withColumn("_s", u * float(total or 0.0)).withColumn("_b", bucket("_s"))
    return asked.join(cum, "_b").where((F.col("_lo") <= F.col("_s")) & (F.col("_s") < F.col("_hi")))


def nodes(spark: SparkSession, n: int, distr: str = "UniformSquareXY", seed: int = 0, existing: DataFrame | None = None, **o) -> DataFrame:
    """Node table; ids that exist are replaced."""
    fresh = locations(spark, n, distr, seed, **o)
    return fresh if existing is None else existing.join(fresh.select("node_id"), "node_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def neighbourhoods(df: DataFrame, shape: str = "Circle", loc: str = "loc", out: str = "neighbor", sides: int = 30, seed: int = 0, **o) -> DataFrame:
    """Column `out`: a polygon around each location."""
    p, key = F.col(loc), F.col(o.get("key", "node_id"))
    steps = F.sequence(F.lit(0), F.lit(sides - 1))
    if shape == "Poly":
        (ring,) = _need(o, "poly")
        return df.withColumn(out, F.transform(poly(ring), lambda v: pt(p.x + v.x, p.y + v.y)))
    if shape == "Circle":
        (radius,) = _need(o, "radius")
        return df.withColumn(out, F.transform(steps, lambda i: at_bearing(p, i * (360.0 / sides), float(radius))))
    if shape == "IsoCircle":
        (radii,) = _need(o, "radii")
        around = lambda r: F.transform(steps, lambda i: at_bearing(p, i * (360.0 / sides), float(r)))
        return df.withColumn(out, F.array(*map(around, radii)))
    if shape == "Egg":
        a, b, c = _need(o, "a", "b", "c")
        turn = math.radians(o.get("direction", 0.0))

        def egg(i: Column) -> Column:
            t = i * (2 * math.pi / sides)
            u = F.when(F.cos(t) >= 0, F.lit(float(a))).otherwise(F.lit(float(b))) * F.cos(t)
            v = float(c) * F.sin(t)
            return pt(p.x + u * math.sin(turn) + v * math.cos(turn), p.y + u * math.cos(turn) - v * math.sin(turn))

        return df.withColumn(out, F.transform(steps, egg))
    if shape == "RndSquare":
        low, high = o.get("min_len", 1.0), o.get("max_len", 2.0)
        half = (low + (high - low) * unit(seed, key, F.lit("w"))) / 2
        return df.withColumn(out, F.array(*(pt(p.x + sx * half, p.y + sy * half) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)))))
    if shape in ("RndCurvy", "RndStar", "RndConvexPoly"):
        low, high, n = o.get("min_radius", 1.0), o.get("max_radius", 2.0), o.get("corners", 7)
        around = F.sequence(F.lit(0), F.lit((sides if shape == "RndCurvy" else 2 * n if shape == "RndStar" else n) - 1))
        count = sides if shape == "RndCurvy" else 2 * n if shape == "RndStar" else n
        if shape == "RndCurvy":
            radius = lambda i: low + (high - low) * (0.5 + 0.25 * F.sin(i * (4 * math.pi / sides) + 6.283 * unit(seed, key, F.lit("p"))) + 0.25 * F.sin(i * (6 * math.pi / sides) + 6.283 * unit(seed, key, F.lit("q"))))
        elif shape == "RndStar":
            radius = lambda i: F.when(i % 2 == 0, F.lit(float(high))).otherwise(low * (0.5 + 0.5 * unit(seed, key, i)))
        else:
            radius = lambda i: low + (high - low) * unit(seed, key, i)
        ring = F.transform(around, lambda i: at_bearing(p, 360.0 - i * (360.0 / count), radius(i)))
        return df.withColumn(out, convex(ring) if shape == "RndConvexPoly" else ring)
    raise UnsupportedInputError(f"unknown neighbourhood {shape}")


@F.pandas_udf(POLY_TYPE)
def convex(rings: pd.Series) -> pd.Series:
    """Convex hull of each ring."""
    return pd.Series([[{"x": x, "y": y} for x, y in overlay.convex_hull([(p["x"], p["y"]) for p in r])] for r in rings])


def arcs(spark: SparkSession, n: int, seed: int = 0, x_range=(0, 100), y_range=(0, 100), min_len: float = 1, max_len: float = 10, min_deg: float = 0, max_deg: float = 360) -> DataFrame:
    """(arc_id, arc) of random length and bearing from a random start."""
    i = F.col("arc_id")
    a = square(i, seed, x_range, y_range)
    deg, way = min_deg + (max_deg - min_deg) * unit(seed, i, F.lit("deg")), min_len + (max_len - min_len) * unit(seed, i, F.lit("len"))
    return spark.range(n).withColumnRenamed("id", "arc_id").withColumn("_a", a).select("arc_id", F.struct(F.col("_a").alias("a"), at_bearing(F.col("_a"), deg, way).alias("b")).alias("arc"))


def arc_neighbourhoods(df: DataFrame, radius: float, arc: str = "arc", sides: int = 30) -> DataFrame:
    """nei_between, nei_a, nei_b and nei_all: the band beside an arc, the disks at its ends and the capsule."""
    a, b = F.col(f"{arc}.a"), F.col(f"{arc}.b")
    d = distance(a, b)
    nx, ny = -(b.y - a.y) / d * radius, (b.x - a.x) / d * radius
    base = F.degrees(F.atan2(b.x - a.x, b.y - a.y))
    half = F.sequence(F.lit(0), F.lit(sides // 2))
    cap = lambda c, start: F.transform(half, lambda i: at_bearing(c, start + i * (360.0 / sides), radius))
    ring = lambda c: F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: at_bearing(c, i * (360.0 / sides), radius))
    band = F.array(pt(a.x + nx, a.y + ny), pt(a.x - nx, a.y - ny), pt(b.x - nx, b.y - ny), pt(b.x + nx, b.y + ny))
    return df.withColumns({"nei_between": band, "nei_a": ring(a), "nei_b": ring(b), "nei_all": F.concat(cap(b, base - 90.0), cap(a, base + 90.0))})


def polygons(spark: SparkSession, n: int, seed: int = 0, shape: str = "RndConvexPoly", overlap: bool = True, tries: int = 20, x_range=(0, 100), y_range=(0, 100), **o) -> DataFrame:
    """(poly_id, anchor, poly); without overlap a polygon that meets an earlier one is drawn again, `tries` times at most."""
    anchors = spark.range(n if overlap else n * tries).withColumnRenamed("id", "node_id")
    df = neighbourhoods(anchors.withColumn("loc", square(F.col("node_id"), seed, x_range, y_range)), shape, seed=seed, **o)
    df = df.select(F.col("node_id").alias("poly_id"), F.col("loc").alias("anchor"), F.col("neighbor").alias("poly"))
    if overlap:
        return df

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, rows = [], []
        for row in pdf.sort_values("poly_id").itertuples():
            ring = [(p["x"], p["y"]) for p in row.poly]
            if len(rows) < n and all(not overlay.intersection([ring, other]) for other in kept):
                kept.append(ring)
                rows.append({"poly_id": len(rows), "anchor": row.anchor, "poly": row.poly})
        return pd.DataFrame(rows, columns=["poly_id", "anchor", "poly"])

    return df.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: greedy(pdf.drop(columns="_g")), f"poly_id long, anchor struct<x:double,y:double>, poly {POLY}")


def weighted_pick(items: DataFrame, draws: DataFrame, weight: str, key: str, seed: int = 0, draw: str = "draw") -> DataFrame:
    """(draw, key): one item for each draw by weight."""
    out = _by_share(draws, items.select(key, weight), weight, key, unit(seed, draw))
    return out.select(draw, key)
