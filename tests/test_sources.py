import json

import pytest

from lodeway.errors import EmptyError, KeyExistError, KeyNotExistError, MissingParameterError, SolverNotAvailableError, UnsupportedInputError
from lodeway.operators import aggregates, generators, pairs, structures
from lodeway.sources import readers


def test_roads(spark, tmp_path):
    f = lambda props, kind, c: {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": c}}
    path = tmp_path / "roads.json"
    path.write_text(
        json.dumps(
            {
                "type": "FeatureCollection",
                "features": [
                    f({"highway": "primary", "name": "A", "maxspeed": "45 mph", "oneway": "yes"}, "LineString", [[10, 50], [11, 51]]),
                    f({"highway": "residential"}, "LineString", [[20, 60], [21, 61]]),
                    f({"waterway": "river"}, "LineString", [[0, 0], [1, 1]]),
                    f({"building": "yes"}, "MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]),
                ],
            }
        )
    )
    rows = {r["class"]: r for r in readers.read_roads(spark, str(path)).collect()}
    assert rows["primary"]["maxspeed"] == 45 and rows["primary"]["oneway"] and rows["residential"]["maxspeed"] == 30 and not rows["residential"]["oneway"]
    assert [(p["x"], p["y"]) for p in rows["primary"]["shape"]] == [(50, 10), (51, 11)]
    assert readers.read_roads(spark, str(path), boundary=[(49, 9), (52, 9), (52, 12), (49, 12)]).count() == 1
    b = readers.read_buildings(spark, str(path)).first()
    assert b["type"] == "building" and len(b["shape"]) == 3


def test_text_instance(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("C101\n\nVEHICLE\nNUMBER CAPACITY\n 25 200\n\nCUST NO. XCOORD.\n\n 0 40 50 0 0 1236 0\n 1 45 68 10 912 967 90\n")
    rows = sorted(readers.read_windows_instance(spark, str(path)).collect())
    assert [(r["node_id"], r["lo"], r["hi"]) for r in rows] == [(0, 0, 1236), (1, 912, 967)]


def test_tables_and_regions(spark, tmp_path):
    df = spark.createDataFrame([(110000, "P"), (110100, "C"), (110101, "D")], "adcode long, name string")
    readers.save_table(df, str(tmp_path / "t"))
    regions = readers.load_table(spark, str(tmp_path / "t"))
    row = readers.region_names(spark.createDataFrame([(110101,)], "adcode long"), regions).first()
    assert (row["province"], row["city"], row["district"]) == ("P", "C", "D")
    assert readers.region_code(regions, "P", "C", "D") == 110101
    with pytest.raises(KeyNotExistError):
        readers.region_code(regions, "P", "X")
    g = spark.createDataFrame([(110000, '{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6]]]}')], "adcode long, geometry string")
    assert readers.region_polygons(g, [110000]).first()["poly"][0]["x"] == 2
    with pytest.raises(SolverNotAvailableError):
        readers.road_matrix_service()


def test_errors(spark):
    nodes = generators.nodes(spark, 3, seed=1)
    with pytest.raises(UnsupportedInputError):
        pairs.distance_table(nodes, "Magic")
    with pytest.raises(MissingParameterError):
        pairs.distance_table(nodes, "Dictionary")
    with pytest.raises(UnsupportedInputError):
        generators.locations(spark, 3, "Magic")
    with pytest.raises(MissingParameterError):
        generators.locations(spark, 3, "UniformCircleXY")
    with pytest.raises(EmptyError):
        aggregates.bounding_box()
    with pytest.raises(KeyExistError):
        structures.unique_keys(nodes.unionByName(nodes), "node_id")


def test_generators_keep_their_shapes(spark):
    inside = generators.locations(spark, 200, "UniformPolyXY", 2, poly=[(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]).collect()
    assert all(0 <= r["loc"]["x"] <= 10 for r in inside)
    out = generators.locations(spark, 200, "UniformAvoidPolyXY", 2, poly=[(20, 20), (80, 20), (80, 80), (20, 80)]).collect()
    assert not any(20 < r["loc"]["x"] < 80 and 20 < r["loc"]["y"] < 80 for r in out)
    assert generators.locations(spark, 5, "UniformCircleLatLon", 2, center=(50.0, 10.0), radius=1000).count() == 5
    base = generators.nodes(spark, 4, seed=2)
    for shape, o in {"Circle": {"radius": 2}, "Egg": {"a": 2, "b": 1, "c": 1}, "RndSquare": {}, "RndCurvy": {}, "RndStar": {}, "RndConvexPoly": {}, "Poly": {"poly": [(0, 0), (1, 0), (0, 1)]}, "IsoCircle": {"radii": [1, 2]}}.items():
        assert all(len(r["neighbor"]) >= 2 for r in generators.neighbourhoods(base, shape, **o).collect())
    assert generators.nodes(spark, 2, seed=5, existing=base).count() == 4
    assert generators.locations(spark, 3, "UniformCubeXYZ", 1).first()["loc"]["z"] >= 0


def test_region_codes_of_country_and_direct_counties(spark):
    from lodeway.sources import readers

    names = spark.createDataFrame([(410000, "P"), (410800, "C"), (410802, "D"), (419001, "J"), (100000, "all")], "adcode long, name string")
    codes = spark.createDataFrame([(100000,), (419001,), (410802,), (410800,), (410000,)], "adcode long")
    got = {r["adcode"]: (r["province"], r["city"], r["district"]) for r in readers.region_names(codes, names).collect()}
    assert got == {100000: (None, None, None), 419001: ("P", "C", "J"), 410802: ("P", "C", "D"), 410800: ("P", "C", None), 410000: ("P", None, None)}


def test_locations_on_clipped_roads(spark):
    from lodeway.operators import generators

    roads = spark.createDataFrame([(1, [(30.0, 110.0), (30.0, 112.0)], "primary"), (2, [(29.5, 110.5), (30.5, 110.5)], "residential"), (3, [(35.0, 110.0), (36.0, 110.0)], "primary")], "road_id long, shape array<struct<x:double,y:double>>, class string")
    box = [(29.9, 110.2), (29.9, 110.8), (30.1, 110.8), (30.1, 110.2)]
    inside = generators.locations(spark, 200, "RoadNetworkPolyLatLon", 3, roads=roads, poly=box).collect()
    assert len(inside) == 200 and all(29.9 <= r["loc"]["x"] <= 30.1 and 110.2 <= r["loc"]["y"] <= 110.8 for r in inside)
    main = generators.locations(spark, 50, "RoadNetworkPolyLatLon", 3, roads=roads, poly=box, classes=["primary"]).collect()
    assert len(main) == 50 and {r["loc"]["x"] for r in main} == {30.0}
    near = generators.locations(spark, 100, "RoadNetworkCircleLatLon", 3, roads=roads, center=(30.0, 110.5), radius=5000.0).collect()
    assert len(near) == 100 and all(abs(r["loc"]["x"] - 30) < 0.05 and abs(r["loc"]["y"] - 110.5) < 0.06 for r in near)
    free = generators.locations(spark, 500, "UniformAvoidPolyXY", 5, poly=[(1, 1), (99, 1), (99, 99), (1, 99)]).collect()
    assert all(r["loc"] is not None and not (1 < r["loc"]["x"] < 99 and 1 < r["loc"]["y"] < 99) for r in free)
