import os
import shutil
import subprocess
import sys

import pytest
from compare import same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeway.errors import OutOfRangeError
from lodeway.operators import structures
from lodeway.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert same(spark, small, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_and_repeats(spark, small, name):
    once = sorted(map(str, QUERIES[name](spark, small).collect()))
    assert once
    if name.startswith(("generated", "tsp_", "weighted")):
        assert once == sorted(map(str, QUERIES[name](spark, small).repartition(3).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["lodeway/llm"], ["lodeway/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_optional_parts(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for part in ("__spark_entry__.py", "corpus_pipeline.py", "lodeway"):
        if os.path.isdir(f"{root}/{part}"):
            shutil.copytree(f"{root}/{part}", tmp_path / part, ignore=shutil.ignore_patterns("llm" if f"{part}/llm" in gone else "__pycache__"))
        elif part not in gone and os.path.exists(f"{root}/{part}"):
            shutil.copy(f"{root}/{part}", tmp_path / part)
    code = "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names = set(said.stdout.split())
    assert set(QUERIES) <= names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("lodeway/llm" not in gone and os.path.isdir(f"{root}/lodeway/llm"))


def test_distance_join_is_an_equi_join(spark, small):
    plan = QUERIES["isochrone_cell_join"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tree_levels_of_a_long_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(200, 50), (300, 999), (301, 300)]
    got = {r["id"]: r for r in structures.levels(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert {i: r["level"] for i, r in got.items()} == {i: i for i in range(100)} | {200: 51}
    assert got[99]["path"] == list(range(100)) and got[200]["path"] == [*range(51), 200]


@pytest.mark.parametrize("rows", [[(1, None), (2, 3), (3, 2)], [(1, 1)], [(1, None), (2, 4), (3, 2), (4, 3), (5, 4)]])
def test_tree_levels_raises_on_a_cycle(spark, rows):
    with pytest.raises(OutOfRangeError):
        structures.levels(spark.createDataFrame(rows, "id long, parent long"))


def test_tree_levels_of_no_rows(spark):
    assert structures.levels(spark.createDataFrame([], "id long, parent long")).collect() == []


@pytest.mark.parametrize("name", ["tsp_annealing", "tsp_genetic", "tsp_multistart", "mtsp_min_longest"])
def test_heuristics_solve_whole_nations(spark, tmp_path, name):
    spark.createDataFrame([(i, i % 2) for i in range(50)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    seen = {}
    for r in QUERIES[name](spark, str(tmp_path)).collect():
        seen.setdefault(r["instance_id"], set()).update(map(int, r["seq"].split(",")))
    assert seen == {k: set(range(k, 50, 2)) for k in (0, 1)}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_finds_far_and_crowded_rows(spark, k):
    import math
    import random

    from lodeway.operators import pairs

    rng = random.Random(k)
    left = [(i, (rng.gauss(0, 1), rng.gauss(0, 1))) for i in range(150)] + [(900, (5000.0, -3000.0)), (901, (0.0, 0.0))]
    right = [(i, (rng.gauss(0, 0.2), rng.gauss(0, 0.2))) for i in range(200)] + [(500 + i, (100.0 + i, 50.0)) for i in range(5)] + [(700, (1.0, 0.0)), (701, (1.0, 0.0))]
    schema = "{} long, loc struct<x:double,y:double>"
    a, b = spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r"))
    got = {(r["l"], r["rank"]): (r["r"], r["dist"]) for r in pairs.nearest(a, b, "l", "r", k).collect()}
    assert len(got) == k * len(left)
    for i, p in left:
        best = sorted((math.sqrt((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2), j) for j, q in right)[:k]
        for rank, (dist, j) in enumerate(best, 1):
            assert math.isclose(got[i, rank][1], dist, abs_tol=1e-12) and (got[i, rank][0] == j or math.isclose(dist, best[rank - 2][0]) or rank == k)
    few = pairs.nearest(a, b.limit(2), "l", "r", 3)
    assert few.count() == 2 * len(left)
    assert pairs.nearest(a, b.where("false"), "l", "r").collect() == [] == pairs.nearest(a.where("false"), b, "l", "r").collect()
    plan = pairs.nearest(a, b, "l", "r", k)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bearings_are_not_rounded_to_ties(spark):
    from lodeway.functions.shapes import pt
    from lodeway.operators import ranking

    rows = [(1, (1e-15, 5.0)), (2, (0.0, 9.0)), (3, (0.0, 0.0)), (4, (-5.0, 0.0))]
    nodes = spark.createDataFrame(rows, "node_id long, loc struct<x:double,y:double>")
    order = lambda **o: [r["node_id"] for r in ranking.by_bearing(nodes, pt(0.0, 0.0), **o).orderBy("seq").collect()]
    assert order() == [2, 1, 4, 3]
    assert order(at_ref=0.0) == [3, 2, 1, 4]


def test_bearings_at_the_centre_as_in_sql(spark, tmp_path):
    keys = [k for k in range(3640, 2 * 10007 * 9973, 10007) if k * 104729 % 9973 == 5000][:1]
    spark.createDataFrame([(k, 1) for k in [*keys, 5, 6]], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    import duckdb

    duckdb.sql(f"create or replace view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in QUERIES["nodes_by_bearing"](spark, str(tmp_path)).collect())
    assert mine == sorted(duckdb.sql(ORACLES["nodes_by_bearing"]).fetchall())


def test_bearings_of_nearly_one_direction_as_in_sql(spark, tmp_path):
    """Java's atan2 ordered these otherwise than that of SQL (F6)."""
    keys = [148263, 649951, 601342, 679069, 599400, 500999, 864960, 57853]
    spark.createDataFrame([(k, 1) for k in keys], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    import duckdb

    duckdb.sql(f"create or replace view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in QUERIES["nodes_by_bearing"](spark, str(tmp_path)).collect())
    assert mine == sorted(duckdb.sql(ORACLES["nodes_by_bearing"]).fetchall())


def test_route_changes_by_place_equal_those_by_table(spark):
    from pyspark.sql import functions as F

    from lodeway.functions.shapes import pt
    from lodeway.operators import pairs

    c = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("g"), pt(F.col("id") * 7 % 11, F.col("id") * 5 % 13).alias("loc"))
    r = c.where("node_id < 40").groupBy(F.col("g").alias("route_id")).agg(F.array_sort(F.collect_list("node_id")).alias("seq"))
    rest = c.where("node_id >= 40").select(F.col("g").alias("route_id"), "node_id")
    tau = pairs.distance_table(c, "Euclidean", group="g").select("src", "dst", "dist")
    rows = lambda df: sorted(map(tuple, df.collect()))
    removed, inserted = structures.largest_removals_by_place(r, c), structures.cheapest_insertions_by_place(r, rest, c)
    assert rows(removed) == rows(structures.largest_removals(r, tau))
    assert rows(inserted) == rows(structures.cheapest_insertions(r, rest, tau)) and inserted.count() == 20


@pytest.mark.parametrize("name", ["removal_savings", "insertion_costs"])
def test_route_changes_form_no_pairs_of_nodes(spark, small, name, monkeypatch):
    from lodeway.operators import pairs

    monkeypatch.setattr(pairs, "distance_table", None)
    assert QUERIES[name](spark, small).count() > 0


def test_grid_distances_come_from_one_small_table(spark):
    from lodeway.functions.shapes import pt
    from lodeway.operators import pairs
    from pyspark.sql import functions as F

    walls = [(1, 0), (1, 1), (3, 3), (2, 3), (3, 2)]
    c = spark.range(30).select(F.col("id").alias("node_id"), pt(F.col("id") % 6 - 1, F.floor(F.col("id") / 6)).alias("loc"))
    got = pairs.distance_table(c, "Grid", column=4, row=4, barriers=walls)
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = pairs.distance_table(c, "Grid", column=4, row=4, barriers=walls, path=True).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("dist is null").count() > 0


def test_grid_tables_unfold_arrays_of_nodes(spark, monkeypatch):
    """each pair was joined, and looked up by another join."""
    from lodeway.functions.shapes import pt
    from lodeway.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "SHARE", 5)
    k, walls = F.col("id"), [(1, 0), (1, 1), (3, 3), (2, 3), (3, 2)]
    own = F.when(k == 30, F.lit(None)).otherwise(F.when(k < 20, k % 2).otherwise(F.lit(7)))
    c = spark.range(31).select(k.alias("node_id"), own.alias("g"), F.when(k != 3, pt(k * 7 % 6 - 1, k * 5 % 7 - 1)).alias("loc"))
    got = pairs.distance_table(c, "Grid", group="g", column=4, row=5, barriers=walls)
    left, right = pairs._sides(c, "node_id", "loc", "g")
    want = pairs._measure(left.join(right, "instance_id"), "Grid", False, None, None, 4, 5, walls, "meter").drop("src_loc", "dst_loc")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 300
    assert 0 < got.where("dist is null").count() < 300 and "Generate inline" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["seg", "ray", "line"])
def test_shapes_are_kept_only_near_polygons(spark, kind):
    from pyspark.sql import functions as F

    from lodeway.functions import intersections as ix
    from lodeway.functions.shapes import line, poly, pt
    from lodeway.operators import spatial

    k = F.col("id")
    rows = spark.range(400).select("id", line(pt(k % 7 * 3 - 4, F.floor(k / 7) % 6 * 3 - 4), pt(k * 5 % 11 - 3, k * 3 % 13 - 5)).alias("s")).where("s.a <> s.b")
    shapes = spark.range(2).select(k.alias("p"), F.when(k == 0, poly([(0, 0), (4, 0), (4, 3), (0, 3)])).otherwise(poly([(6, 5), (9, 8), (5, 9)])).alias("poly"))
    met = lambda df: {(r["id"], r["p"]) for r in df.where(F.size(ix.with_polygon(kind, F.col("s"), F.col("poly"))) > 0).collect()}
    near = spatial.shapes_near_polygons(kind, rows, shapes)
    assert met(near) == met(rows.crossJoin(shapes)) and near.count() < rows.count() * 2


def _odd_roads(spark):
    import random

    from lodeway.functions.shapes import poly

    rng = random.Random(4)
    lattice = [[(float(rng.randrange(-2, 9)), float(rng.randrange(-2, 9))) for _ in range(rng.randrange(2, 9))] for _ in range(150)]
    free = [[(rng.uniform(-2, 9), rng.uniform(-2, 9)) for _ in range(rng.randrange(2, 9))] for _ in range(150)]
    odd = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)], [(-1.0, 4.0), (1.0, 2.0), (-1.0, 0.0)], [(2.0, 2.0), None, (3.0, 1.0), (9.0, 1.0)], [(-1.0, 3.005), (9.0, 3.005)]]
    roads = spark.createDataFrame([(i, r) for i, r in enumerate(lattice + free + odd)], "road_id long, shape array<struct<x:double,y:double>>")
    rings = [[(0, 0), (4, 0), (4, 3), (0, 3)], [(6, 5), (9, 8), (5, 9)], [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)], [(3, 3), (3.005, 3), (5, 3), (5, 5)]]
    polygons = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("poly_id"), poly(r).alias("poly")) for i, r in enumerate(rings)))).alias("p")).select("p.*")
    return roads, polygons


def test_clipped_roads_equal_the_expression(spark):
    from lodeway.functions import intersections as ix
    from lodeway.operators import spatial

    roads, polygons = _odd_roads(spark)
    got = spatial.clip_roads(roads, polygons, cell=3.0)
    parts = roads.crossJoin(polygons).select("road_id", "poly_id", F.posexplode(ix.polyline_in_polygon(F.col("shape"), F.col("poly"))).alias("part", "shape"))
    want = parts.where("size(shape) > 1")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 300
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_polygon_events_equal_those_of_the_segments(spark):
    from lodeway.functions import intersections as ix
    from lodeway.functions.predicates import box_meets_segment
    from lodeway.functions.sequences import remove_degenerate
    from lodeway.functions.shapes import distance, segments
    from lodeway.operators import spatial

    roads, polygons = _odd_roads(spark)
    roads = roads.where("not exists(shape, p -> p is null)")
    got = spatial.polygon_events(roads, polygons, "road_id", "poly_id", "shape", cell=3.0)
    cut = roads.crossJoin(polygons).select("road_id", "poly_id", "poly", F.posexplode(segments(remove_degenerate(F.col("shape")))).alias("i", "s"))
    near = box_meets_segment(F.col("s"), spatial.box_struct("poly"))
    held = {}
    for r in cut.select("road_id", "poly_id", "i", distance(F.col("s.a"), F.col("s.b")).alias("d"), F.when(near, ix.inside_ranges("seg", F.col("s"), F.col("poly"))).otherwise(F.array().cast("array<struct<lo:double,hi:double>>")).alias("w")).orderBy("i").collect():
        base, ranges = held.setdefault((r["road_id"], r["poly_id"]), [0.0, []])
        ranges += [(base + w["lo"] * r["d"], base + w["hi"] * r["d"]) for w in r["w"]]
        held[r["road_id"], r["poly_id"]][0] += r["d"]
    want = []
    for (road, ring), (_, ranges) in held.items():
        stays = []
        for lo, hi in sorted(ranges):
            if stays and lo <= stays[-1][1] + 0.01:
                stays[-1][1] = max(stays[-1][1], hi)
            else:
                stays.append([lo, hi])
        for lo, hi in stays:
            want += [(road, ring, lo, "touch")] if hi - lo <= 0.01 else [(road, ring, lo, "enter"), (road, ring, hi, "leave")]
    rows = lambda x: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in x)
    assert rows(got.collect()) == rows(want) and {e for *_, e in want} == {"enter", "leave", "touch"}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("edges", ["Euclidean", "Manhattan", "LatLon"])
def test_distance_tables_unfold_arrays_of_nodes(spark, monkeypatch, edges):
    from lodeway.functions.shapes import pt
    from lodeway.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "SHARE", 5)
    k = F.col("id")
    own = F.when(k == 30, F.lit(None)).otherwise(F.when(k < 20, k % 2).otherwise(F.lit(7)))
    c = spark.range(31).select(k.alias("node_id"), own.alias("g"), F.when(k != 3, pt(k * 7 % 11, k * 5 % 13)).alias("loc"))
    for path in (False, True):
        got = pairs.distance_table(c, edges, group="g", path=path)
        left, right = pairs._sides(c, "node_id", "loc", "g")
        want = pairs._measure(left.join(right, "instance_id"), edges, path, None, None, None, None, None, "meter").drop("src_loc", "dst_loc")
        text = lambda df: sorted(str((r["instance_id"], r["src"], r["dst"], r["dist"], r["path"] if path and 3 not in (r["src"], r["dst"]) else None)) for r in df.collect())
        assert got.columns == want.columns and text(got) == text(want) and got.count() == 300
    assert "Generate inline" in pairs.distance_table(c, edges, group="g")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["distance_table_manhattan", "distance_table_geographic"])
def test_distance_tables_move_nodes_once_for_thousands_of_rows(spark, tmp_path, name):
    """an instance's nodes are moved once for each share of its rows, which was most of the disk used."""
    from lodeway.operators import pairs

    n = 5000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    context = spark.sparkContext

    def written():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    moved = [v for k, v in written().items() if k not in before]
    blocks = -(-n // pairs.BLOCK)
    assert blocks in moved and 2 * blocks not in moved
