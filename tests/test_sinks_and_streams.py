import math

import pytest
from pyspark.sql import functions as F

from lodeway.errors import OutOfRangeError, SolverNotAvailableError, UnsupportedInputError
from lodeway.functions import overlays
from lodeway.functions.shapes import line, poly, pt
from lodeway.operators import spatial
from lodeway.sinks import svg
from lodeway.solvers import touring
from lodeway.streaming import trips

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_drawing(spark, tmp_path):
    df = spark.range(3).select("id", pt(F.col("id"), F.col("id") * 2).alias("loc"), poly(SQUARE).alias("poly"), line(pt(0, 0), pt(1, F.col("id"))).alias("arc"))
    d = svg.Drawing().points(df, label="id").polygons(df).arcs(df)
    d.save(str(tmp_path / "x.svg"))
    text = (tmp_path / "x.svg").read_text()
    assert text.count("<circle") == 3 and text.count("<polygon") == 3 and text.count("<polyline") == 3
    with pytest.raises(OutOfRangeError):
        svg.Drawing(limit=2).points(df)


def test_gantt_and_frames(spark):
    g = spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 3.0), ("a", 4.0, 5.0)], "entity_id string, lo double, hi double")
    assert svg.gantt(g).svg().count("<polygon") == 3
    with pytest.raises(UnsupportedInputError):
        svg.gantt(spark.createDataFrame([("a", 3.0, 2.0)], "entity_id string, lo double, hi double"))
    f = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 0.0)], "id long, t double, x double, y double")
    rows = svg.frames(f, "id", 0.0, 10.0, speed=1.0, fps=1).orderBy("tick").collect()
    assert [r["x"] for r in rows] == list(range(11))
    assert svg.shown(g, 1.5).count() == 2


def test_overlay_columns(spark):
    def parts(q):
        return spark.range(1).select(overlays.polygon_polygon(poly(SQUARE), poly(q)).alias("p")).first()["p"]

    assert [r["type"] for r in parts([(5, 5), (15, 5), (15, 15), (5, 15)])] == ["Polygon"]
    assert [r["type"] for r in parts([(10, 2), (20, 2), (20, 8), (10, 8)])] == ["Segment"]
    assert [r["type"] for r in parts([(10, 10), (20, 10), (20, 20), (10, 20)])] == ["Point"]
    assert parts([(30, 30), (40, 30), (40, 40)]) == []
    assert len(spark.range(1).select(overlays.triangulate(poly(SQUARE)).alias("t")).first()["t"]) == 2


def test_route_events(spark):
    r = spark.range(1).select(F.col("id").alias("road_id"), poly([(-5, 5), (5, 5), (5, 20), (5, 10), (12, 10)]).alias("seq"))
    p = spark.range(1).select(F.col("id").alias("poly_id"), poly(SQUARE).alias("poly"))
    got = [(r["event"], r["mileage"]) for r in spatial.polygon_events(r, p, "road_id", "poly_id").orderBy("mileage").collect()]
    assert got[0] == ("enter", 5) and got[1] == ("leave", 15) and {e for e, _ in got[2:]} <= {"enter", "leave", "touch"}
    pieces = spatial.label_pieces(spatial.polygon_events(r, p, "road_id", "poly_id"), r, "road_id", "poly_id").orderBy("lo").collect()
    assert pieces[0]["polygons"] == [] and pieces[1]["polygons"] == [0] and pieces[1]["hi"] == 15


def test_service_programs():
    pieces, demand = [(10, {1}), (5, {1, 2}), (5, {2})], {1: 18.0, 2: 16.0}
    over = touring.service_times(pieces, demand, 1.0)
    assert math.isclose(sum(over), 26) and over[0] + over[1] >= 18 - 1e-9 and over[1] + over[2] >= 16 - 1e-9
    apart = touring.service_times(pieces, demand, 1.0, "AccuNonOverlap")
    assert math.isclose(sum(apart), 34)
    assert math.isclose(sum(touring.service_times(pieces, {1: 12.0, 2: 8.0}, 1.0, "AccuNonOverlap")), 20)
    with pytest.raises(SolverNotAvailableError):
        touring.service_times(pieces, demand, 1.0, "ContOverlap")


def test_geofence_and_sessions(spark, tmp_path):
    rows = [(1, float(t), float(t), 5.0) for t in range(-3, 14)]
    spark.createDataFrame(rows, "object_id long, t double, x double, y double").coalesce(1).write.parquet(str(tmp_path / "f"))
    s = spark.readStream.schema("object_id long, t double, x double, y double").parquet(str(tmp_path / "f"))
    got = trips.run_to_table(trips.geofence(s, {7: SQUARE}), "fence").orderBy("t").collect()
    assert [(r["event"], r["poly_id"], r["t"]) for r in got] == [("enter", 7, 0.0), ("leave", 7, 10.0)]
    e = s.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * F.when(F.col("t") > 5, 1000).otherwise(1)))
    assert trips.run_to_table(trips.trips(e, "ts", "object_id", "10 minutes"), "sessions", "complete").count() >= 2


def test_drawing_in_space(spark):
    rows = spark.createDataFrame([(1, (0.0, 0.0, 0.0), (0.0, 0.0), 5.0), (2, (1.0, 2.0, 3.0), (10.0, 0.0), 4.0)], "id long, loc struct<x:double,y:double,z:double>, center struct<x:double,y:double>, max_height double")
    solid = rows.selectExpr("array(array(loc, struct(loc.x + 1 AS x, loc.y AS y, loc.z AS z), struct(loc.x AS x, loc.y + 1 AS y, loc.z + 1 AS z))) AS faces", "array(loc, struct(0D AS x, 0D AS y, 9D AS z)) AS seq")
    d = svg.Drawing3D().points(rows, label="id").cones(rows).polyhedra(solid).polylines(solid)
    text = d.svg()
    assert text.count("<circle") == 2 and text.count("<polygon") == 4 and text.count("<polyline") == 2 * 4 + 2
    # what stands higher is drawn higher
    assert d._at({"x": 0.0, "y": 0.0, "z": 1.0})[1] > d._at({"x": 0.0, "y": 0.0, "z": 0.0})[1]
    rings = spark.createDataFrame([("a", [(30.0, 110.0), (30.0, 111.0), (31.0, 111.0)])], "name string, poly array<struct<x:double,y:double>>")
    assert svg.region_map(rings, label="name").svg().count("<text") == 1


def test_streams_leave_their_rows_in_files(spark, tmp_path):
    rows = [(k, float(t), float(t * k), 0.0) for k in (1, 2) for t in (2, 0, 1)]
    schema = "object_id long, t double, x double, y double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "f"))
    out = trips.run_to_table(trips.steps(spark.readStream.schema(schema).parquet(str(tmp_path / "f"))), "stepped")
    assert out.inputFiles() and "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["object_id"], r["t"], r["step"]) for r in spark.table("stepped").collect()) == [(k, t, k * min(t, 1.0)) for k in (1, 2) for t in (0.0, 1.0, 2.0)]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert trips.run_to_table(trips.steps(spark.readStream.schema(schema).parquet(str(tmp_path / "none"))), "nothing").collect() == []
