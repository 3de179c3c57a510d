"""Structured Streaming forms of the trajectory operators.

Late data: rows behind the watermark are dropped; the batch operators keep all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checkpoints import folder
from ..solvers.overlay import contains

STEP = "object_id long, t double, x double, y double, step double"
EVENT = "object_id long, t double, poly_id long, event string"


def steps(fixes: DataFrame) -> DataFrame:
    """Way of each fix (object_id, t, x, y) from the fix before; state is one fix for each object.

    Fixes of one micro-batch are put in the order of time; one that comes after
    a later batch counts from the last known place.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        t, x, y = (np.concatenate([f[c].to_numpy(float) for f in held]) for c in "txy")
        order = np.lexsort((y, x, t))
        t, x, y = t[order], x[order], y[order]
        last = state.get if state.exists else (t[0], x[0], y[0])
        way = np.sqrt((x - np.append(last[1], x[:-1])) ** 2 + (y - np.append(last[2], y[:-1])) ** 2)
        state.update((float(t[-1]), float(x[-1]), float(y[-1])))
        yield pd.DataFrame({"object_id": key[0], "t": t, "x": x, "y": y, "step": way})

    return fixes.groupBy("object_id").applyInPandasWithState(update, STEP, "t double, x double, y double", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = (), **aggs) -> DataFrame:
    """Tumbling or sliding windows with a watermark; aggs name the outputs."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(span.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)


def trips(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of one object that a gap of silence ends."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def geofence(fixes: DataFrame, polygons: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """Enter and leave events of fixes on constant polygons; state is the set of polygons an object is in."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)]).sort_values(["t", "x", "y"], kind="stable")
        held = set(state.get[0]) if state.exists else set()
        out = []
        for r in rows.itertuples():
            now = {p for p, ring in polygons.items() if contains(ring, r.x, r.y)}
            out += [(key[0], float(r.t), p, "leave") for p in sorted(held - now)] + [(key[0], float(r.t), p, "enter") for p in sorted(now - held)]
            held = now
        state.update((sorted(held),))
        yield pd.DataFrame(out, columns=["object_id", "t", "poly_id", "event"])

    return fixes.groupBy("object_id").applyInPandasWithState(update, EVENT, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end and read what it wrote, also as the view `name`.

    Rows go to files beside the checkpoints, so the driver holds none of them;
    the modes complete and update keep the result of the last batch.
    """
    spark = stream.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{at}/rows"
    # a stream without rows leaves this one
    spark.createDataFrame([], stream.schema).write.parquet(path)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    out = out.format("parquet").option("path", path) if mode == "append" else out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    table = spark.read.schema(stream.schema).parquet(path)
    table.createOrReplaceTempView(name)
    return table
