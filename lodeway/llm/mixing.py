"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .keys import SPACE, cut, row_key

LEAF_ROWS = 4096
FAN_IN = 256
SCHEMA = "k long, v long, doc_id long, source string, size long, n long, bucket long, copies long, mass double"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs and target of each source, from rows (source, size); one row for each source goes to one task.

    Sources in code point order, null last, take the weights in turn and share
    `share` of all words; no target passes `most` times its source.  Filling: in
    the order of cap over weight, the sources before the first that fits are at
    their cap and the rest share what is left by weight.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    filling = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("turn", F.row_number().over(filling)).withColumn("level", left / weight)
    fits = F.when(F.col("ratio") >= F.col("level"), F.struct("turn", "level"))
    level = F.min(fits).over(every)["level"]
    return ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "n_docs", "target")


def pivot(pdf: pd.DataFrame, seed: int, final: bool) -> pd.DataFrame:
    """Meet the fractional copies of one group in pairs until at most one is left.

    Masses are words: what one document gives the other takes, up to where one
    of the two is integral, so the words of the group stay the same; the odds of
    the two ways keep each expectation.  Documents meet from large to small, so
    large ones settle each other and the one left over is small.  One too large
    to be settled by single partners (its square exceeds the sum of squares of
    all smaller ones) first meets these as one partner, which takes its part in
    the same way.  At the root of its tree the last one is rounded at random: the
    source misses its target by less than that document's size.
    """
    pdf = pdf.sort_values(["size", "k", "v"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, mass, copies = pdf["size"].to_numpy(float), pdf["mass"].to_numpy(float).copy(), pdf["copies"].to_numpy(np.int64).copy()
    first = np.uint64(int(pdf["k"].iloc[0]) & tn.MASK) if len(pdf) else np.uint64(0)
    rng = np.random.default_rng([seed, int(tn.mix(np.array([first]))[0])])

    def settle(at: np.ndarray) -> None:
        none, all_ = mass[at] <= 1e-9 * size[at], mass[at] >= size[at] * (1 - 1e-9)
        copies[at[all_]] += 1
        mass[at[none | all_]] = np.nan

    def step(up: float, down: float) -> float:
        return up if rng.random() * (up + down) < down else -down

    settle(np.flatnonzero(~np.isnan(mass)))
    open_ = np.flatnonzero(~np.isnan(mass))
    squares = np.append(np.cumsum((size[open_] ** 2)[::-1])[::-1], 0.0)
    for i in open_[size[open_] ** 2 > squares[1:]]:
        while not np.isnan(mass[i]):
            rest = np.flatnonzero(~np.isnan(mass))
            rest = rest[rest > i]
            if not len(rest):
                break
            part = np.minimum(mass[rest], size[rest] - mass[rest])
            part /= part.sum()
            up, down = min(size[i] - mass[i], (mass[rest] / part).min()), min(mass[i], ((size[rest] - mass[rest]) / part).min())
            move = step(up, down)
            mass[i] += move
            mass[rest] -= move * part
            settle(np.append(i, rest))
    held = -1
    for j in np.flatnonzero(~np.isnan(mass)):
        if held < 0:
            held = j
            continue
        move = step(min(size[held] - mass[held], mass[j]), min(mass[held], size[j] - mass[j]))
        mass[held] += move
        mass[j] -= move
        settle(np.array([held, j]))
        held = held if not np.isnan(mass[held]) else j if not np.isnan(mass[j]) else -1
    if final and held >= 0:
        copies[held] += int(rng.random() * size[held] < mass[held])
        mass[held] = np.nan
    pdf["copies"], pdf["mass"] = copies, pd.Series(mass).astype(float)
    return pdf


def _reduce(rows: DataFrame, seed: int, final: bool) -> DataFrame:
    return rows.groupBy("source", "bucket").applyInPandas(lambda pdf: pivot(pdf, seed, final), SCHEMA)


def _row(docs: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    """What a row is known by: its key, a hash of its text, and its source."""
    return [row_key(docs[doc_id], docs[text]).alias("k"), F.xxhash64(docs[text].cast("string")).alias("v"), docs[source].cast("string").alias("source")]


def decisions(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many copies the mix takes of each group of rows alike in id, text and source.

    Each row of a source has the same rate, target over source size.  Of a group
    the whole part of rows times rate is taken for certain and the rest decided
    by pivotal rounding in a tree: leaves of about LEAF_ROWS groups of one source
    by hash, then FAN_IN residuals to a node, one for each leaf, up to one root a
    source.  Returns k, v, doc_id, source, size, n (rows), copies (of all of
    them), source_size and target.
    """
    rows = docs.select(*_row(docs, doc_id, text, source), docs[doc_id].cast("long").alias("doc_id"), _count_words(docs[text].cast("string")).alias("size"))
    rows = cut(rows.groupBy("k", "v", "doc_id", "source", "size").agg(F.count("*").alias("n")))
    goal = cut(targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most))
    t = goal.select(F.col("source").alias("_source"), "source_size", "n_docs", "target")
    deep = goal.agg(F.max("n_docs")).first()[0] or 0
    leaves = max(1, math.ceil(deep / LEAF_ROWS))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    bucket = F.pmod(F.xxhash64("k", "v", F.lit(seed)), F.ceil(F.col("n_docs") / LEAF_ROWS).cast("long"))
    start = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("all", rate * F.col("n")).withColumn("bucket", bucket)
    whole = F.floor("all")
    level = start.select("k", "v", "doc_id", "source", "size", "n", "bucket", whole.alias("copies"), F.when(F.col("size") > 0, (F.col("all") - whole) * F.col("size")).cast("double").alias("mass"))
    done = None
    while True:
        final = leaves == 1
        level = cut(_reduce(level, seed, final))
        settled = level if final else level.where("mass is null")
        done = settled if done is None else done.unionByName(settled)
        if final:
            break
        leaves = math.ceil(leaves / FAN_IN)
        level = level.where("mass is not null").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        seed += 1
    done = done.join(t, F.col("source").eqNullSafe(F.col("_source")))
    return done.select("k", "v", "doc_id", "source", "size", "n", "copies", "source_size", "target")


def _share(copies: str, n: str, turn: Column) -> Column:
    """Copies of the row with that number in a group of n rows that has so many copies together."""
    return F.expr(f"{copies} div {n}") + (turn <= F.col(copies) % F.col(n)).cast("long")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document; options are those of `decisions`.

    Returns k, doc_id, size, source, source_size, target, copies and taken, one
    row for each row of docs.

    Corner cases: null and empty texts have size 0 and take 0 words; a null
    source is a source and comes last; rows without an id are known by their
    text; of n rows alike in id, text and source the copies of all differ by one
    at most; texts that share an id are decided one by one; other columns are
    ignored; an empty table gives an empty result.  Reruns agree, whatever the
    partitions.
    """
    rows = decisions(docs, **options).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("copies", _share("copies", "n", F.col("turn")).cast("int"))
    return rows.select("k", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of docs as often as the mix takes it, all columns kept.

    Rows alike in id, text and source get the copies of their group between
    them, each as many as the others or one more.  Corner cases as in mixture;
    rows whose other columns differ are kept as they are.
    """
    names = {c: options.get(c, c) for c in ("doc_id", "text", "source")}
    same = ["k", "v", "h"]
    found = cut(decisions(docs, **options).select("k", "v", F.xxhash64("source").alias("h"), "n", "copies"))
    rows = docs.select(*_row(docs, **names), F.struct("*").alias("row")).withColumn("h", F.xxhash64("source")).drop("source")
    even, odd = found.where("copies > 0 and copies % n = 0"), found.where("copies % n <> 0")
    out = rows.join(even, same).select("row", F.expr("copies div n").alias("copies"))
    if not odd.isEmpty():
        # number the rows of a group by partition and place, so that no group goes to one task
        some = cut(rows.join(odd, same).withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
        here = Window.partitionBy(*same, "pid").orderBy("at")
        before = Window.partitionBy(*same).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        counts = some.groupBy(*same, "pid").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        some = some.withColumn("turn", F.row_number().over(here)).join(counts, [*same, "pid"])
        out = out.unionByName(some.select("row", _share("copies", "n", F.col("turn") + F.col("before")).alias("copies")))
    return out.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


def _count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1))), F.lit(0)).cast("long")
