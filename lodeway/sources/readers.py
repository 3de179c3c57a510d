"""Readers and writers: road GeoJSON, instance text files, tables, region codes, logs."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import KeyNotExistError, SolverNotAvailableError
from ..functions.predicates import polyline_meets_polygon
from ..functions.shapes import poly
from ..functions.vectors import geographic_to_mercator

GEOJSON = """features array<struct<
  properties: struct<highway:string,name:string,maxspeed:string,oneway:string,building:string>,
  geometry: struct<type:string,coordinates:string>>>"""
log = logging.getLogger("lodeway")
#: The code of the whole country, and county codes whose city code isn't their first four digits.
COUNTRY = 100000
DIRECT = {419001: 410800}


def _features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each feature; coordinates stay JSON text, as their depth differs by type.

    lines: each line of the files is a feature collection of its own, so that
    large files are split over tasks.
    """
    whole = spark.read.schema(GEOJSON).option("multiLine", not lines).json(path)
    return whole.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _points(coordinates):
    return F.transform(coordinates, lambda p: F.struct(p[1].alias("x"), p[0].alias("y")))


def read_roads(spark: SparkSession, path: str, boundary: list | None = None, mercator: bool = False, default_speed: float = 30.0, lines: bool = False) -> DataFrame:
    """(road_id, shape, name, maxspeed, oneway, class) of the lines with a highway class; points are (lat, lon).

    maxspeed takes the leading number and defaults to 30, oneway to false.
    boundary keeps roads that meet that (lat, lon) polygon.
    """
    f = _features(spark, path, lines).where("kind = 'LineString' and highway is not null")
    shape = _points(F.from_json("coordinates", "array<array<double>>"))
    df = f.select(
        shape.alias("shape"),
        "name",
        F.coalesce(F.regexp_extract("maxspeed", r"(\d+(?:\.\d+)?)", 1).cast("double"), F.lit(default_speed)).alias("maxspeed"),
        F.coalesce(F.col("oneway").isin("yes", "true", "True", "1"), F.lit(False)).alias("oneway"),
        F.col("highway").alias("class"),
    )
    if boundary is not None:
        df = df.where(polyline_meets_polygon(F.col("shape"), poly(boundary)))
    if mercator:
        df = df.withColumn("shape", F.transform("shape", geographic_to_mercator))
    return _numbered(df, "road_id", "shape", "name", "class", "maxspeed", "oneway")


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Consecutive ids in the order of all given columns: ranges are sorted apart, then start at the sum of those before."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return out.withColumn(key, F.col("_before") + local).drop("_part", "_before", "_at")


def read_buildings(spark: SparkSession, path: str, mercator: bool = False) -> DataFrame:
    """(building_id, shape, type) of the first ring of buildings; 'yes' becomes 'building'."""
    f = _features(spark, path).where("kind = 'MultiPolygon' and building is not null")
    ring = _points(F.from_json("coordinates", "array<array<array<array<double>>>>")[0][0])
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    df = f.select(open_.alias("shape"), F.when(F.col("building") == "yes", F.lit("building")).otherwise(F.col("building")).alias("type"))
    if mercator:
        df = df.withColumn("shape", F.transform("shape", geographic_to_mercator))
    return _numbered(df, "building_id", "shape", "type")


def read_windows_instance(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a text instance: lines of seven numbers `id x y demand ready due service`, blank separated."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") == 7) & F.forall("p", lambda v: v.rlike(r"^-?\d+(\.\d+)?$")))
    names = ("x", "y", "demand", "lo", "hi", "service_time")
    return rows.select(F.col("p")[0].cast("long").alias("node_id"), *(F.col("p")[i + 1].cast("double").alias(n) for i, n in enumerate(names)))


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def region_names(codes: DataFrame, regions: DataFrame, code: str = "adcode") -> DataFrame:
    """province, city and district of six-digit codes, by two joins on the truncated code.

    regions(adcode, name) is given by the user.  A code that ends in 0000 is a
    province, one in 00 a city.  The code of the whole country has no names, and
    codes of DIRECT are filed under the city given there.
    """
    r = lambda n: regions.select(F.col("adcode").alias(f"_{n}"), F.col("name").alias(n))
    c = F.col(code)
    city = F.floor(c / 100) * 100
    for one, under in DIRECT.items():
        city = F.when(c == one, F.lit(under)).otherwise(city)
    df = codes.withColumns({"_province": F.when(c != COUNTRY, F.floor(c / 10000) * 10000), "_city": F.when(c % 10000 != 0, city), "_district": F.when(c % 100 != 0, c)})
    for n in ("province", "city", "district"):
        df = df.join(r(n), f"_{n}", "left")
    return df.drop("_province", "_city", "_district")


def region_code(regions: DataFrame, province: str, city: str | None = None, district: str | None = None) -> int:
    """Code of a region by its names, each level within the one above; raises where there is none."""
    code = F.col("adcode")
    found = regions.where((F.col("name") == province) & (code % 10000 == 0)).agg(F.min("adcode")).first()[0]
    if found is not None and city is not None:
        found = regions.where((F.col("name") == city) & (code % 100 == 0) & (code % 10000 != 0) & (F.floor(code / 10000) * 10000 == found)).agg(F.min("adcode")).first()[0]
    if found is not None and district is not None:
        found = regions.where((F.col("name") == district) & (code % 100 != 0) & (F.floor(code / 100) * 100 == found)).agg(F.min("adcode")).first()[0]
    if found is None:
        raise KeyNotExistError("no such region")
    return int(found)


def region_codes(asks: DataFrame, regions: DataFrame) -> DataFrame:
    """Column adcode for rows (province, city[, district]) by joins level by level; NULL where there is none."""
    c = F.col("adcode")
    level = lambda keep, name, code: regions.where(keep).groupBy(F.col("name").alias(name), *([F.floor(c / 10000).alias("_p")] if name != "province" else []), *([F.floor(c / 100).alias("_c")] if name == "district" else [])).agg(F.min(c).alias(code))
    out = asks.join(level(c % 10000 == 0, "province", "_province"), "province", "left").withColumn("_p", F.floor(F.col("_province") / 10000))
    out = out.join(level((c % 100 == 0) & (c % 10000 != 0), "city", "_city"), ["city", "_p"], "left")
    found = F.when(F.col("city").isNull(), F.col("_province")).otherwise(F.col("_city"))
    if "district" in asks.columns:
        out = out.withColumn("_c", F.floor(F.col("_city") / 100)).join(level(c % 100 != 0, "district", "_district"), ["district", "_p", "_c"], "left")
        found = F.when(F.col("district").isNull(), found).otherwise(F.col("_district"))
    return out.withColumn("adcode", found).select(*asks.columns, "adcode")


def region_polygons(boundaries: DataFrame, codes: list[int]) -> DataFrame:
    """(adcode, part, poly) of regions from an offline boundary table (adcode, geometry as GeoJSON text); points are (lat, lon)."""
    g = boundaries.where(F.col("adcode").isin(codes)).withColumn("kind", F.get_json_object("geometry", "$.type")).withColumn("c", F.get_json_object("geometry", "$.coordinates"))
    many = F.when(F.col("kind") == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("c", "array<array<array<double>>>")))
    return g.select("adcode", F.posexplode(many).alias("part", "rings")).select("adcode", "part", _points(F.col("rings")[0]).alias("poly"))


def road_matrix_service(*_args, **_options) -> DataFrame:
    raise SolverNotAvailableError("route-matrix web services are not reachable; give a table with edges='Dictionary'")


@contextmanager
def timed(*keys: str, totals: dict | None = None):
    """Add the seconds and calls of a block to totals[keys] and to the log."""
    began = time.perf_counter()
    try:
        yield
    finally:
        spent = time.perf_counter() - began
        if totals is not None:
            held = totals.setdefault(keys, [0.0, 0])
            held[0] += spent
            held[1] += 1
        log.info("%s %.3f s", "/".join(keys), spent)


def write_log(text: str) -> None:
    log.info(text)
