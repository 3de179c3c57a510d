"""Streaming queries, run to the end of a bounded input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import trips
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(spark, sf_dir):
    out = trips.windowed(_stream(spark, sf_dir), "ts", "1 day", keys=("event_type",), n=F.count("*"))
    t = trips.run_to_table(out, f"w{uuid.uuid4().hex}", "complete")
    return t.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


QUERIES["stream_windows"] = stream_windows
ORACLES["stream_windows"] = "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2"


def stream_steps(spark, sf_dir):
    e = _stream(spark, sf_dir)
    p = fx.point("event_id", 7919, 104729, 5)
    f = e.select(F.col("user_id").cast("long").alias("object_id"), (F.unix_micros("ts") / F.lit(1e6)).alias("t"), p.x.alias("x"), p.y.alias("y"))
    t = trips.run_to_table(trips.steps(f), f"s{uuid.uuid4().hex}")
    return t.groupBy("object_id").agg(F.round(F.sum("step"), 4).alias("mileage"), F.count("*").alias("n"))


QUERIES["stream_steps"] = stream_steps
ORACLES["stream_steps"] = (
    fx.with_("fix")
    + """, s AS (SELECT user_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fix WINDOW w AS (PARTITION BY user_id ORDER BY t, x, y))
SELECT CAST(user_id AS BIGINT) AS object_id, round(sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)), 4) AS mileage, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id"""
)
