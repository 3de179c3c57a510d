"""Spatial joins of points, polylines and polygons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import intersections as ix
from ..functions.distances import length
from ..functions.predicates import box_meets_segment, point_in_polygon, polygon_meets_polygon
from ..functions.sequences import remove_degenerate
from ..functions.shapes import POLY_TYPE, distance
from ..solvers import clip
from ..tolerance import DEFAULT, Tolerance


def _cells(df: DataFrame, x0, x1, y0, y1, size: float) -> DataFrame:
    """One row for each grid cell that a box touches."""
    run = lambda a, b: F.explode(F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long")))
    return df.withColumn("_cx", run(x0, x1)).withColumn("_cy", run(y0, y1))


def _box(df: DataFrame, shape: str) -> dict:
    xs, ys = F.transform(shape, lambda p: p.x), F.transform(shape, lambda p: p.y)
    return {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}


def box_struct(shape: str):
    """Bounding box of a ring column as struct(x_min, x_max, y_min, y_max)."""
    b = _box(None, shape)
    return F.struct(b["x0"].alias("x_min"), b["x1"].alias("x_max"), b["y0"].alias("y_min"), b["y1"].alias("y_max"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, loc: str = "loc", ring: str = "poly", cell: float = 10.0, interior: bool = False) -> DataFrame:
    """Pairs of points and polygons that hold them: equi-join on grid cells, then the exact test.

    A point has one cell, so each pair meets once.
    """
    b = _box(polygons, ring)
    q = _cells(polygons, b["x0"], b["x1"], b["y0"], b["y1"], cell)
    p = points.withColumns({"_cx": F.floor(F.col(loc).x / cell).cast("long"), "_cy": F.floor(F.col(loc).y / cell).cast("long")})
    return p.join(q, ["_cx", "_cy"]).where(point_in_polygon(F.col(loc), F.col(ring), interior)).drop("_cx", "_cy")


def segments_near_polygons(rows: DataFrame, polygons: DataFrame, segment: str = "s", ring: str = "poly", cell: float = 10.0) -> DataFrame:
    """Pairs of segments and polygons whose bounding box they meet: equi-join on grid cells, then the exact test; each pair once."""
    s = F.col(segment)
    own = {"_sx0": F.least(s.a.x, s.b.x), "_sx1": F.greatest(s.a.x, s.b.x), "_sy0": F.least(s.a.y, s.b.y), "_sy1": F.greatest(s.a.y, s.b.y)}
    a = _cells(rows.withColumns(own), F.col("_sx0"), F.col("_sx1"), F.col("_sy0"), F.col("_sy1"), cell)
    q = polygons.withColumn("_box", box_struct(ring))
    q = _cells(q, F.col("_box.x_min"), F.col("_box.x_max"), F.col("_box.y_min"), F.col("_box.y_max"), cell)
    once = (F.col("_cx") == F.floor(F.greatest("_sx0", "_box.x_min") / cell)) & (F.col("_cy") == F.floor(F.greatest("_sy0", "_box.y_min") / cell))
    met = a.join(q, ["_cx", "_cy"]).where(once & box_meets_segment(s, F.col("_box")))
    return met.drop("_cx", "_cy", "_box", *own)


def shapes_near_polygons(kind: str, rows: DataFrame, polygons: DataFrame, segment: str = "s", ring: str = "poly", tol: Tolerance = DEFAULT) -> DataFrame:
    """Pairs of shapes (kind: seg, ray or line) and a few polygons whose boxes, wider by twice the tolerance, they meet.

    Rows are dealt over all tasks, as a small file of shapes is much work with every polygon.
    """
    s, box, more = F.col(segment), F.col("_box"), 2 * tol.point
    wide = box_struct(ring)
    q = polygons.withColumn("_box", F.struct(*((wide[f"{c}_{e}"] + by).alias(f"{c}_{e}") for c in "xy" for e, by in (("min", -more), ("max", more)))))
    dealt = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    # so far that the box lies behind neither end
    far = F.abs(box.x_min - s.a.x) + F.abs(box.x_max - s.a.x) + F.abs(box.y_min - s.a.y) + F.abs(box.y_max - s.a.y)
    times = F.greatest(F.lit(1.0), far / F.sqrt(dx * dx + dy * dy))
    at = lambda r: F.struct((s.a.x + r * dx).alias("x"), (s.a.y + r * dy).alias("y"))
    reach = {"seg": s, "ray": F.struct(s.a.alias("a"), at(times).alias("b")), "line": F.struct(at(-times).alias("a"), at(times).alias("b"))}[kind]
    near = F.coalesce(box_meets_segment(reach, box), F.lit(True))
    return dealt.join(F.broadcast(q), near).drop("_box")


def polygon_overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ring: str = "poly", right_ring: str = "poly", cell: float = 10.0) -> DataFrame:
    """(left key, right key) of filled polygons that meet: cells, boxes, then the exact test."""
    a = left.select(F.col(left_key).alias("_l"), F.col(left_ring).alias("_p"))
    b = right.select(F.col(right_key).alias("_r"), F.col(right_ring).alias("_q"))
    ba, bb = _box(a, "_p"), _box(b, "_q")
    a = _cells(a.withColumns({f"a{k}": v for k, v in ba.items()}), F.col("ax0"), F.col("ax1"), F.col("ay0"), F.col("ay1"), cell)
    b = _cells(b.withColumns({f"b{k}": v for k, v in bb.items()}), F.col("bx0"), F.col("bx1"), F.col("by0"), F.col("by1"), cell)
    first = (F.col("_cx") == F.floor(F.greatest("ax0", "bx0") / cell)) & (F.col("_cy") == F.floor(F.greatest("ay0", "by0") / cell))
    boxes = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    out = a.join(b, ["_cx", "_cy"]).where(boxes & first).where(polygon_meets_polygon(F.col("_p"), F.col("_q")))
    return out.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key))


def _lines_near_polygons(lines: DataFrame, polygons: DataFrame, shape: str, ring: str, cell: float) -> DataFrame:
    """Pairs of polylines and polygons whose boxes meet, with the columns of both: equi-join on grid cells; each pair once."""
    a = lines.withColumns({f"_a{k}": v for k, v in _box(lines, shape).items()})
    b = polygons.withColumns({f"_b{k}": v for k, v in _box(polygons, ring).items()})
    a = _cells(a, F.col("_ax0"), F.col("_ax1"), F.col("_ay0"), F.col("_ay1"), cell)
    b = _cells(b, F.col("_bx0"), F.col("_bx1"), F.col("_by0"), F.col("_by1"), cell)
    first = (F.col("_cx") == F.floor(F.greatest("_ax0", "_bx0") / cell)) & (F.col("_cy") == F.floor(F.greatest("_ay0", "_by0") / cell))
    boxes = (F.col("_ax0") <= F.col("_bx1")) & (F.col("_bx0") <= F.col("_ax1")) & (F.col("_ay0") <= F.col("_by1")) & (F.col("_by0") <= F.col("_ay1"))
    return a.join(b, ["_cx", "_cy"]).where(first & boxes)


def clip_roads(roads: DataFrame, polygons: DataFrame, key: str = "road_id", shape: str = "shape", ring: str = "poly", cell: float = 25.0, tol: Tolerance = DEFAULT) -> DataFrame:
    """Parts of roads in polygons: (road key, poly columns, part, shape); roads and polygons meet by cells and boxes first.

    The parts are those of `intersections.polyline_in_polygon`, cut in Arrow batches.
    """
    own = [c for c in roads.columns if c != shape]
    other = [c for c in polygons.columns if c not in (ring, *roads.columns)]
    met = _lines_near_polygons(roads, polygons.select(*other, F.col(ring).alias("_ring")), shape, "_ring", cell)
    met = met.select(*own, *other, F.col(shape).cast(POLY_TYPE).alias("_line"), F.col("_ring").cast(POLY_TYPE).alias("_ring"))

    def run(batches):
        for whole in batches:
            for batch in clip.slices(whole, "_line"):
                row, part, size, x, y = clip.Parts(clip.Shapes(batch.column("_line")), clip.Shapes(batch.column("_ring")), tol).polylines()
                many = size > 1
                points = np.repeat(many, size)
                shapes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[many])), pa.int32()), pa.StructArray.from_arrays([pa.array(x[points]), pa.array(y[points])], ["x", "y"]))
                kept = batch.select([*own, *other]).take(pa.array(row[many]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(part[many], pa.int32()), shapes], [*own, *other, "part", shape])

    schema = StructType([*(met.schema[c] for c in (*own, *other)), StructField("part", IntegerType()), StructField(shape, POLY_TYPE)])
    return met.mapInArrow(run, schema)


def renumber(parts: DataFrame, key: str = "road_id", order: tuple[str, ...] = ("part",), start: int = 0) -> DataFrame:
    """New consecutive ids in the order of key and `order`; small clipped sets only (one sort)."""
    return parts.withColumn("new_id", F.row_number().over(Window.orderBy(key, *order)) - 1 + start)


def polygon_events(routes: DataFrame, polygons: DataFrame, route_key: str, poly_key: str, seq: str = "seq", ring: str = "poly", cell: float = 25.0, tol: Tolerance = DEFAULT) -> DataFrame:
    """Enter, leave and touch events of routes on polygons, with mileage: (route, polygon, mileage, event).

    Routes and polygons meet by cells and boxes; in Arrow batches each segment is
    cut by each polygon near it, and ranges that go on from segment to segment
    are joined.
    """
    lines = routes.select(F.col(route_key).alias("_r"), remove_degenerate(F.col(seq), tol).alias("_line"))
    met = _lines_near_polygons(lines, polygons.select(F.col(poly_key).alias("_q"), F.col(ring).alias("_ring")), "_line", "_ring", cell)
    met = met.select("_r", "_q", F.col("_line").cast(POLY_TYPE).alias("_line"), F.col("_ring").cast(POLY_TYPE).alias("_ring"))

    def run(batches):
        for whole in batches:
            for batch in clip.slices(whole, "_line"):
                row, lo, hi = clip.Parts(clip.Shapes(batch.column("_line")), clip.Shapes(batch.column("_ring")), tol).stays()
                touch = hi - lo <= tol.point
                at = np.repeat(np.arange(len(row)), np.where(touch, 1, 2))
                leave = np.append(False, at[1:] == at[:-1])[: len(at)]
                kept = batch.select(["_r", "_q"]).take(pa.array(row[at]))
                event = np.where(touch[at], "touch", np.where(leave, "leave", "enter"))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.where(leave, hi[at], lo[at])), pa.array(event, pa.string())], ["_r", "_q", "mileage", "event"])

    out = met.mapInArrow(run, StructType([met.schema["_r"], met.schema["_q"], StructField("mileage", DoubleType()), StructField("event", StringType())]))
    return out.withColumnsRenamed({"_r": route_key, "_q": poly_key})


def label_pieces(events: DataFrame, routes: DataFrame, route_key: str, poly_key: str, seq: str = "seq") -> DataFrame:
    """Cut routes at their events: (route, lo, hi, polygons that hold the piece, sorted)."""
    full = routes.select(F.col(route_key).alias("_r"), length(F.col(seq)).alias("total"))
    moves = events.where("event <> 'touch'").select(F.col(route_key).alias("_r"), F.col(poly_key).alias("_q"), "mileage", F.when(F.col("event") == "enter", 1).otherwise(-1).alias("step"))
    ends = full.select("_r", F.explode(F.array(F.lit(0.0), F.col("total"))).alias("mileage"))
    cuts = moves.select("_r", "mileage").unionByName(ends).distinct()
    w = Window.partitionBy("_r").orderBy("mileage")
    pieces = cuts.withColumn("hi", F.lead("mileage").over(w)).where("hi is not null").withColumnRenamed("mileage", "lo")
    stays = moves.withColumn("hi2", F.lead("mileage").over(Window.partitionBy("_r", "_q").orderBy("mileage", F.desc("step")))).where("step = 1").select("_r", "_q", F.col("mileage").alias("lo2"), "hi2")
    held = pieces.join(stays, "_r", "left").withColumn("in", (F.col("lo2") <= F.col("lo")) & (F.col("hi") <= F.col("hi2")))
    out = held.groupBy("_r", "lo", "hi").agg(F.array_sort(F.collect_set(F.when(F.col("in"), F.col("_q")))).alias("polygons"))
    return out.withColumnRenamed("_r", route_key)


def visit_order(events: DataFrame, route_key: str, poly_key: str) -> DataFrame:
    """First visit of each polygon on a route: (route, polygon, mileage, event, seq)."""
    first = events.where("event <> 'leave'").groupBy(route_key, poly_key).agg(F.min(F.struct("mileage", "event")).alias("e"))
    out = first.select(route_key, poly_key, "e.mileage", "e.event")
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(route_key).orderBy("mileage", poly_key)))


def visibility(polygons: DataFrame, key: str = "poly_id", ring: str = "poly") -> DataFrame:
    """Pairs of polygon vertices that see each other: vertex pairs less those that an edge or an interior blocks.

    Obstacle sets are small by contract; the pairs are the result itself.
    """
    v = polygons.select(F.col(key).alias("poly_id"), F.posexplode(ring).alias("vertex", "loc"))
    a = v.select(*(F.col(c).alias(f"a_{c}") for c in v.columns))
    b = v.select(*(F.col(c).alias(f"b_{c}") for c in v.columns))
    order = (F.col("a_poly_id") < F.col("b_poly_id")) | ((F.col("a_poly_id") == F.col("b_poly_id")) & (F.col("a_vertex") < F.col("b_vertex")))
    pairs = a.join(b, order)
    seg = F.struct(F.col("a_loc").alias("a"), F.col("b_loc").alias("b"))
    b = _box(polygons, ring)
    box = F.struct(b["x0"].alias("x_min"), b["x1"].alias("x_max"), b["y0"].alias("y_min"), b["y1"].alias("y_max"))
    walls = polygons.select(F.col(ring).alias("_wall"), box.alias("_box"))
    inner = F.exists(ix.with_polygon("seg", seg, F.col("_wall")), lambda part: part["interior"])
    blocked = F.when(box_meets_segment(seg, F.col("_box")), inner).otherwise(F.lit(False))
    return pairs.join(walls, blocked, "left_anti").select("a_poly_id", "a_vertex", "b_poly_id", "b_vertex", distance(F.col("a_loc"), F.col("b_loc")).alias("dist"))
