"""Run a query in Spark and its twin in DuckDB and compare the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    rel = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
