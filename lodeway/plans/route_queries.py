"""Queries on the route solvers; iterative, so tested against brute force instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routes
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def _rounded(df):
    return df.select("instance_id", "method", F.round("ofv", 6).alias("ofv"), F.round("dist", 6).alias("dist"), F.concat_ws(",", F.col("seq").cast("array<string>")).alias("seq"))


def _tsp(name: str, most: int | None = None, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(routes.solve_tsp(fx.instances(spark, sf_dir, most), **options))


for _cons in ("Insertion", "RandomInsertion", "NearestNeighbor", "FarthestNeighbor", "Sweep", "Christofides", "Random"):
    _tsp(f"tsp_{_cons.lower()}", cons=_cons, impv=None)
_tsp("tsp_two_opt", cons="Insertion", impv="2Opt+OrOpt")
_tsp("tsp_exact", most=9, algo="Exact")
_tsp("tsp_annealing", algo="Metaheuristic", meta="SA", cons="NearestNeighbor")
_tsp("tsp_genetic", algo="Metaheuristic", meta="GA")
QUERIES["tsp_multistart"] = lambda spark, sf_dir: _rounded(routes.solve_multistart(fx.instances(spark, sf_dir), 3, "GA"))
QUERIES["tsptw_hard"] = lambda spark, sf_dir: _rounded(routes.solve_tsptw(fx.instances(spark, sf_dir, 6).withColumns({"lo": F.lit(0.0), "hi": F.col("hi") + 400.0}), speed=2.0))
QUERIES["tsptw_violation"] = lambda spark, sf_dir: _rounded(routes.solve_tsptw(fx.instances(spark, sf_dir, 7).withColumn("hi", F.when(F.row_number().over(_first()) == 1, 1e6).otherwise(F.col("hi"))), allow_violation=True))
QUERIES["orienteering"] = lambda spark, sf_dir: _rounded(routes.solve_op(fx.instances(spark, sf_dir, 10), 200.0))
QUERIES["vrptw"] = lambda spark, sf_dir: _rounded(routes.solve_vrptw(fx.instances(spark, sf_dir, 7).withColumns({"lo": F.lit(0.0), "hi": F.col("hi") + 600.0}), 4, 15.0))
QUERIES["vrptw_thirty"] = lambda spark, sf_dir: routes.solve_vrptw(fx.instances(spark, sf_dir, 31).withColumns({"lo": F.lit(0.0), "hi": F.col("hi") + 600.0}), 30, 40.0).select("instance_id", "method", F.round("ofv", 6).alias("ofv"), F.round("lower_bound", 6).alias("lower_bound"), "solution")
QUERIES["tsp_exact_bounded"] = lambda spark, sf_dir: routes.solve_tsp(fx.instances(spark, sf_dir, 18), algo="Exact").select("instance_id", F.round("ofv", 6).alias("ofv"), F.round("lower_bound", 6).alias("lower_bound"), F.round("gap", 9).alias("gap"), "solution")
QUERIES["mtsp_min_longest"] = lambda spark, sf_dir: _rounded(routes.solve_mtsp(fx.instances(spark, sf_dir), 3))
QUERIES["cetsp_circles"] = lambda spark, sf_dir: _rounded(routes.solve_cetsp(fx.instances(spark, sf_dir, 6).withColumn("radius", F.lit(5.0)), (0.0, 0.0), (100.0, 100.0)))
QUERIES["cetsp_exact"] = lambda spark, sf_dir: _rounded(routes.solve_cetsp(fx.instances(spark, sf_dir, 5).withColumn("radius", F.lit(5.0)), (0.0, 0.0), (100.0, 100.0), algo="Exact"))
QUERIES["route_rows"] = lambda spark, sf_dir: routes.route_rows(routes.solve_tsp(fx.instances(spark, sf_dir, 9), algo="Exact"), fx.instances(spark, sf_dir, 9)).withColumn("t", F.round("t", 6))


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("instance_id").orderBy("node_id")


def _seq(df):
    return df.withColumn("seq", F.row_number().over(_first()))


QUERIES["touring_circles"] = lambda spark, sf_dir: routes.touring_path(_seq(fx.instances(spark, sf_dir, 6)).withColumn("radius", F.lit(6.0)), (0.0, 0.0), (100.0, 0.0)).select("instance_id", F.round("dist", 4).alias("dist"), F.size("path").alias("n"))
QUERIES["touring_cones"] = lambda spark, sf_dir: routes.cone_path(_seq(fx.instances(spark, sf_dir, 4)).withColumn("max_height", F.lit(10.0)), (0.0, 0.0, 0.0), (100.0, 0.0, 0.0), 0.5).select("instance_id", F.round("dist", 4).alias("dist"), F.size("path").alias("n"))
QUERIES["chase_targets"] = lambda spark, sf_dir: routes.chase_path(_seq(fx.instances(spark, sf_dir, 5)).withColumns({"vx": F.lit(0.2), "vy": F.lit(-0.1)}), (0.0, 0.0), (100.0, 0.0), 1.0).select("instance_id", F.round("t", 5).alias("t"), F.size("path").alias("n"))
