"""Rings, trees, ordered maps and schedules as columns and tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import KeyExistError, OutOfRangeError
from ..functions.shapes import distance, lit_

# --- rings and routes: an array column that starts at its head ---


def rehead(ring: Column, node) -> Column:
    """The same ring from another node on."""
    i = F.array_position(ring, node).cast("int")
    return F.when(i > 0, F.concat(F.slice(ring, i, F.size(ring) - i + 1), F.slice(ring, F.lit(1), i - 1)))


def traverse(ring: Column, closed: bool = False) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1)) if closed else ring


def insert_after(ring: Column, after, node) -> Column:
    i = F.array_position(ring, after).cast("int")
    return F.when((i > 0) & ~F.array_contains(ring, lit_(node)), F.concat(F.slice(ring, F.lit(1), i), F.array(lit_(node)), F.slice(ring, i + 1, F.size(ring) - i)))


def append(ring: Column, node) -> Column:
    return F.concat(ring, F.array(lit_(node)))


def remove(ring: Column, node) -> Column:
    return F.array_remove(ring, node)


def reverse(ring: Column) -> Column:
    """Other direction, same head."""
    return F.concat(F.slice(ring, 1, 1), F.reverse(F.slice(ring, F.lit(2), F.size(ring) - 1)))


def swap_with_next(ring: Column, node) -> Column:
    """A node and its successor change places."""
    i, n = F.array_position(ring, node).cast("int"), F.size(ring)
    j = i % n + 1
    return F.transform(ring, lambda x, k: F.when(k + 1 == i, F.element_at(ring, j)).when(k + 1 == j, F.element_at(ring, i)).otherwise(x))


def exchange(ring: Column, a, b) -> Column:
    return F.transform(ring, lambda x: F.when(x == a, b).when(x == b, a).otherwise(x))


def rotate(ring: Column, first, last) -> Column:
    """Turn round the stretch from first to last (first stands before last)."""
    i, j = F.array_position(ring, first).cast("int"), F.array_position(ring, last).cast("int")
    return F.when((i > 0) & (j >= i), F.concat(F.slice(ring, F.lit(1), i - 1), F.reverse(F.slice(ring, i, j - i + 1)), F.slice(ring, j + 1, F.size(ring) - j)))


def route_costs(routes: DataFrame, tau: DataFrame, key: str = "route_id", seq: str = "seq") -> DataFrame:
    """(route, dist, rev_dist) of closed routes by an equi-join with the distance table (src, dst, dist)."""
    legs = routes.select(key, F.col(seq), F.posexplode(seq).alias("pos", "src"))
    legs = legs.select(key, "src", F.element_at(seq, (F.col("pos") + 1) % F.size(seq) + 1).alias("dst"))
    ahead = tau.select("src", "dst", "dist")
    back = tau.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dist").alias("rev"))
    return legs.join(ahead, ["src", "dst"]).join(back, ["src", "dst"]).groupBy(key).agg(F.sum("dist").alias("dist"), F.sum("rev").alias("rev_dist"))


def route_lengths(routes: DataFrame, nodes: DataFrame, key: str = "route_id", seq: str = "seq", node: str = "node_id", loc: str = "loc") -> DataFrame:
    """(route, dist, rev_dist) of closed routes from the places of their nodes; only the legs meet the nodes, no pairs of nodes."""
    legs = routes.select(key, F.col(seq), F.posexplode(seq).alias("pos", "_a"))
    legs = legs.select(key, "_a", F.element_at(seq, (F.col("pos") + 1) % F.size(seq) + 1).alias("_b"))
    end = lambda name: nodes.select(F.col(node).alias(name), F.col(loc).alias(f"{name}_at"))
    met = legs.join(end("_a"), "_a").join(end("_b"), "_b").withColumn("d", distance(F.col("_a_at"), F.col("_b_at")))
    return met.groupBy(key).agg(F.sum("d").alias("dist"), F.sum("d").alias("rev_dist"))


def cheapest_insertions(routes: DataFrame, nodes: DataFrame, tau: DataFrame, key: str = "route_id", seq: str = "seq", node: str = "node_id") -> DataFrame:
    """(route, node, after, extra): best place of each node in each route of its instance; ties by position."""
    legs = routes.select(key, F.col(seq), F.posexplode(seq).alias("pos", "src"))
    legs = legs.select(key, "pos", "src", F.element_at(seq, (F.col("pos") + 1) % F.size(seq) + 1).alias("dst"))
    t = lambda a, b, name: tau.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("dist").alias(name))
    met = legs.join(nodes.select(key, F.col(node).alias("n")), key).join(t("src", "n", "d1"), ["src", "n"]).join(t("n", "dst", "d2"), ["n", "dst"]).join(t("src", "dst", "d3"), ["src", "dst"])
    best = met.groupBy(key, "n").agg(F.min(F.struct((F.col("d1") + F.col("d2") - F.col("d3")).alias("extra"), "pos", "src")).alias("b"))
    return best.select(key, F.col("n").alias(node), F.col("b.src").alias("after"), F.col("b.extra").alias("extra"))


def largest_removals(routes: DataFrame, tau: DataFrame, key: str = "route_id", seq: str = "seq") -> DataFrame:
    """(route, node, saved): the node whose removal saves most; ties by position."""
    n = F.size(seq)
    legs = routes.select(key, F.col(seq), F.posexplode(seq).alias("pos", "b"))
    legs = legs.select(key, "pos", "b", F.element_at(seq, (F.col("pos") + n - 1) % n + 1).alias("a"), F.element_at(seq, (F.col("pos") + 1) % n + 1).alias("c"))
    t = lambda a, b, name: tau.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("dist").alias(name))
    met = legs.join(t("a", "b", "d1"), ["a", "b"]).join(t("b", "c", "d2"), ["b", "c"]).join(t("a", "c", "d3"), ["a", "c"])
    best = met.groupBy(key).agg(F.min(F.struct((F.col("d3") - F.col("d1") - F.col("d2")).alias("neg"), "pos", F.col("b").alias("node"))).alias("x"))
    return best.select(key, F.col("x.node").alias("node"), (-F.col("x.neg")).alias("saved"))


def _legs(routes: DataFrame, nodes: DataFrame, steps: tuple[int, ...], key: str, seq: str, node: str, loc: str) -> DataFrame:
    """(key, pos, _n0, _p0, _n1, _p1, ...): each place of a closed route with the nodes so many steps on and their locations."""
    n = F.size(seq)
    out = routes.select(key, F.col(seq), F.posexplode(seq).alias("pos", "_at"))
    out = out.select(key, "pos", *(F.element_at(seq, (F.col("pos") + n + by) % n + 1).alias(f"_n{i}") for i, by in enumerate(steps)))
    for i in range(len(steps)):
        out = out.join(nodes.select(F.col(node).alias(f"_n{i}"), F.col(loc).alias(f"_p{i}")), f"_n{i}")
    return out


def largest_removals_by_place(routes: DataFrame, nodes: DataFrame, key: str = "route_id", seq: str = "seq", node: str = "node_id", loc: str = "loc") -> DataFrame:
    """largest_removals from the places of the nodes (Euclidean); only the legs meet the nodes, no pairs of nodes."""
    met = _legs(routes, nodes, (-1, 0, 1), key, seq, node, loc)
    a, b, c = (F.col(f"_p{i}") for i in range(3))
    best = met.groupBy(key).agg(F.min(F.struct((distance(a, c) - distance(a, b) - distance(b, c)).alias("neg"), "pos", F.col("_n1").alias("node"))).alias("x"))
    return best.select(key, F.col("x.node").alias("node"), (-F.col("x.neg")).alias("saved"))


#: Legs and nodes of one block of cheapest_insertions_by_place.
LEGS, NODES = 8192, 4096


def cheapest_insertions_by_place(routes: DataFrame, nodes: DataFrame, places: DataFrame, key: str = "route_id", seq: str = "seq", node: str = "node_id", loc: str = "loc") -> DataFrame:
    """cheapest_insertions from the places of the nodes (Euclidean): (route, node, after, extra); ties by position.

    Every node is weighed against every leg of its route, but no pair becomes a
    row: blocks of legs meet blocks of nodes as arrays, and each block gives the
    best leg of each of its nodes.
    """
    legs = _legs(routes, places, (0, 1), key, seq, node, loc).withColumn("_leg", F.floor(F.col("pos") / LEGS))
    packed = legs.groupBy(key, "_leg").agg(*(F.collect_list(c).alias(n) for n, c in (("pos", F.col("pos")), ("src", F.col("_n0")), ("ax", F.col("_p0.x")), ("ay", F.col("_p0.y")), ("bx", F.col("_p1.x")), ("by", F.col("_p1.y")))))
    asked = nodes.select(key, node).join(places.select(node, F.col(loc).alias("_at")), node)
    size = asked.groupBy(key).agg(F.count("*").alias("_many"))
    # deal nodes by hash: no order and no task for all nodes of a route is needed
    asked = asked.join(size, key).withColumn("_deal", F.pmod(F.xxhash64(node), F.ceil(F.col("_many") / NODES)))
    dealt = asked.groupBy(key, "_deal").agg(*(F.collect_list(c).alias(n) for n, c in (("n", F.col(node)), ("x", F.col("_at.x")), ("y", F.col("_at.y")))))
    kind = dict(routes.dtypes)[key], dict(places.dtypes)[node]
    schema = f"k {kind[0]}, n {kind[1]}, extra double, pos int, src {kind[1]}"

    def best(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                # legs in the order of the route, so that the first of equal ones is the first on it
                order = np.argsort(r.pos, kind="stable")
                pos, src, ax, ay, bx, by = (np.asarray(v)[order] for v in (r.pos, r.src, r.ax, r.ay, r.bx, r.by))
                own = np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
                at, value = np.empty(len(r.n), int), np.empty(len(r.n))
                for i, (x, y) in enumerate(zip(r.x, r.y, strict=True)):
                    px, py, qx, qy = x - ax, y - ay, bx - x, by - y
                    extra = np.sqrt(px * px + py * py) + np.sqrt(qx * qx + qy * qy) - own
                    at[i] = extra.argmin()
                    value[i] = extra[at[i]]
                yield pd.DataFrame({"k": r.k, "n": r.n, "extra": value, "pos": pos[at], "src": src[at]})

    # as many tasks as there are blocks, up to a few for each core, whatever size the blocks seem to have
    met = dealt.join(packed, key).withColumnRenamed(key, "k").repartition(4 * max(8, routes.sparkSession.sparkContext.defaultParallelism))
    found = met.drop("_deal", "_leg").mapInPandas(best, schema)
    one = found.groupBy("k", "n").agg(F.min(F.struct("extra", "pos", "src")).alias("b"))
    return one.select(F.col("k").alias(key), F.col("n").alias(node), F.col("b.src").alias("after"), F.col("b.extra").alias("extra"))


# --- trees: (id, parent) rows ---


def leaves(tree: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    return tree.join(tree.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def levels(tree: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, level, path) of all nodes under a root, at any depth; raises on a cycle.

    Every row knows the way down from an ancestor; each round joins it with what
    that ancestor knows, so ways double and a tree of depth n takes log2(n)
    rounds.  Nodes under a parent that is not in the table are left out.
    """
    state = cut(tree.select(F.col(key).alias("id"), F.col(parent).alias("above"), F.array(F.col(key)).alias("path")))
    while True:
        open_ = state.where("above is not null")
        found = open_.agg(F.count("*").alias("n"), F.max(F.array_contains("path", F.col("above"))).alias("cycle")).first()
        if found["cycle"]:
            raise OutOfRangeError("a node is its own ancestor")
        if not found["n"]:
            return state.select("id", (F.size("path") - 1).alias("level"), "path")
        up = state.select(F.col("id").alias("over"), F.col("above").alias("next"), F.col("path").alias("way"))
        further = open_.join(up, F.col("above") == F.col("over")).select("id", F.col("next").alias("above"), F.concat("way", "path").alias("path"))
        state = cut(state.where("above is null").unionByName(further))


# --- ordered maps: rows sorted by key ---


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """df unchanged; raises where a key comes twice."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise KeyExistError(f"{key} is not unique")
    return df


def with_neighbour_keys(df: DataFrame, key: str, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(key)
    return df.withColumns({"prev_key": F.lag(key).over(w), "next_key": F.lead(key).over(w)})


def key_range(df: DataFrame, key: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n"))


# --- schedules: jobs in order, each with windows of availability ---


def earliest_in(windows: Column, t: Column) -> Column:
    """Earliest time at or after t in sorted windows array<struct<lo,hi>>; NULL where none is left; no windows: t."""
    fits = F.transform(F.filter(windows, lambda w: w["hi"] >= t), lambda w: F.greatest(w["lo"], t))
    return F.when(F.coalesce(F.size(windows), F.lit(0)) <= 0, t).otherwise(F.array_min(fits))


def schedule(jobs: Column, start: float = 0.0) -> Column:
    """Start and end of jobs (array of struct<id, length, windows>) done one after another."""
    state = F.struct(F.lit(float(start)).alias("now"), F.array().cast("array<struct<id:bigint,ts:double,te:double>>").alias("out"))

    def step(acc: Column, job: Column) -> Column:
        ts = earliest_in(job["windows"], acc["now"])
        te = ts + job["length"]
        return F.struct(te.alias("now"), F.concat(acc["out"], F.array(F.struct(job["id"].cast("bigint").alias("id"), ts.alias("ts"), te.alias("te")))).alias("out"))

    return F.aggregate(jobs, state, step, lambda acc: acc["out"])


def makespan(jobs: Column, start: float = 0.0) -> Column:
    return F.array_max(F.transform(schedule(jobs, start), lambda j: j["te"]))


def insert_job(jobs: Column, job: Column, position: int) -> Column:
    return F.concat(F.slice(jobs, F.lit(1), F.lit(position)), F.array(job), F.slice(jobs, F.lit(position + 1), F.greatest(F.size(jobs) - position, F.lit(0))))


def remove_job(jobs: Column, job_id) -> Column:
    return F.filter(jobs, lambda j: j["id"] != job_id)


def replace_job(jobs: Column, job_id, job: Column) -> Column:
    return F.transform(jobs, lambda j: F.when(j["id"] == job_id, job).otherwise(j))


def exchange_jobs(jobs: Column, a, b) -> Column:
    at = lambda k: F.filter(jobs, lambda j: j["id"] == k)[0]
    return F.transform(jobs, lambda j: F.when(j["id"] == a, at(b)).when(j["id"] == b, at(a)).otherwise(j))


def cheapest_job_insertion(jobs: Column, job: Column) -> Column:
    """struct(makespan, position): where one more job delays the end least; the first on ties."""
    options = F.transform(F.sequence(F.lit(0), F.size(jobs)), lambda p: F.struct(makespan(F.concat(F.slice(jobs, F.lit(1), p), F.array(job), F.slice(jobs, p + 1, F.size(jobs) - p))).alias("makespan"), p.alias("position")))
    return F.array_min(F.filter(options, lambda o: o["makespan"].isNotNull()))
