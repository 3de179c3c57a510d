"""Distance tables by lookup in a table with a row for each source (F4)."""

from __future__ import annotations

from lodeway.functions.shapes import pt
from lodeway.operators import pairs
from lodeway.plans.catalog import queries
from pyspark.sql import functions as F


def _nodes(spark):
    rows = [(i, i % 2, float(i * 7 % 11), float(i * 5 % 13)) for i in range(23)] + [(90, 2, 1.0, 1.0), (91, None, 0.0, 0.0), (None, 3, 0.0, 0.0), (92, 3, 2.0, 0.0), (4, 1, 5.0, 5.0)]
    return spark.createDataFrame(rows, "node_id long, nation_id long, x double, y double").select("node_id", "nation_id", pt(F.col("x"), F.col("y")).alias("loc"))


def test_rows_and_entries_give_the_same_table(spark):
    """Rows that are whole, short, long, out of order or missing; nodes that are null, twice there or in two instances."""
    ids = {k: [i for i in range(23) if i % 2 == k] for k in (0, 1)}
    dist = lambda a, b: None if (a, b) == (2, 4) else a * 100.0 + b
    lists = {i: ids[i % 2] for i in range(23)}
    lists |= {6: ids[0][1:], 8: ids[0][::-1], 10: [*ids[0], 500], 12: [], 90: [90], 92: [92], 700: [1, 2]}
    del lists[14], lists[15]
    rows = [(i, to, [dist(i, j) for j in to]) for i, to in lists.items()]
    table = spark.createDataFrame(rows, "src long, dsts array<long>, dists array<double>")
    flat = spark.createDataFrame([(i, j, d) for i, to, ds in rows for j, d in zip(to, ds, strict=True)], "src long, dst long, dist double")
    key = lambda r: str(tuple(r))
    for options in ({"group": "nation_id"}, {}):
        want = pairs.distance_table(_nodes(spark), "Dictionary", table=flat, **options)
        got = pairs.distance_table(_nodes(spark), "Dictionary", table=table, **options)
        columns = ["instance_id", "src", "dst", "dist"]
        assert sorted(got.select(columns).collect(), key=key) == sorted(want.select(columns).collect(), key=key)
    path = pairs.distance_table(_nodes(spark), "Dictionary", table=table, group="nation_id", path=True)
    assert path.count() == pairs.distance_table(_nodes(spark), "Dictionary", table=flat, group="nation_id", path=True).count()


def test_lookup_moves_nodes_not_pairs(spark, tmp_path):
    """Pairs and their table went through a shuffle each, over the disk limit at size."""
    n = 600
    spark.createDataFrame([(i, 0) for i in range(n)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    df = queries()["distance_table_lookup"](spark, str(tmp_path))
    assert df.count() == n * n
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution()
    df.collect()
    moved = str(plan.executedPlan().toString())
    assert "Generate posexplode" in moved and "BroadcastHashJoin" in moved
    found = moved.split("Generate posexplode")[0]
    assert "SortMergeJoin" not in found


def test_square_tables_are_made_once(spark):
    """rows of the table were made a second time, to find the sources that it lacks."""
    made = spark.sparkContext.accumulator(0)

    def length(x, y, xs, ys):
        made.add(len(x))
        return abs(x - xs) * 2 + abs(y - ys)

    c = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("g"), pt(F.col("id") * 7 % 11, F.col("id") * 5 % 13).alias("loc"))
    square = pairs.table_rows(c, length, group="g")
    rows = pairs.distance_table(c, "Dictionary", group="g", table=square).collect()
    assert len(rows) == len({(r["src"], r["dst"]) for r in rows}) == 1800 and made.value == 60
    assert all(r["dist"] == abs(r["src"] * 7 % 11 - r["dst"] * 7 % 11) * 2 + abs(r["src"] * 5 % 13 - r["dst"] * 5 % 13) for r in rows)


def test_square_tables_of_other_nodes_give_what_entries_give(spark):
    """Instances that have lost or gained nodes, or are not in the table."""
    length = lambda x, y, xs, ys: abs(x - xs) * 2 + abs(y - ys)
    c = spark.range(40).select(F.col("id").alias("node_id"), (F.col("id") % 4).alias("g"), pt(F.col("id") * 7 % 11, F.col("id") * 5 % 13).alias("loc"))
    square = pairs.table_rows(c.where("g < 3"), length, group="g")
    flat = pairs._entries(square.rows())
    nodes = c.where("node_id <> 5").unionByName(c.where("node_id = 2").withColumn("node_id", F.lit(99).cast("long")))
    for options in ({"group": "g"}, {"group": "g", "path": True}, {}):
        text = lambda table: sorted(map(str, pairs.distance_table(nodes, "Dictionary", table=table, **options).select("instance_id", "src", "dst", "dist").collect()))  # noqa: B023, E731
        assert text(square) == text(flat) and len(text(square)) >= 381
