"""Shortest ways on a 4-connected grid with barriers."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shapes import POLY


def a_star(column: int, row: int, barriers: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int], heuristic: str = "Manhattan") -> list[tuple[int, int]] | None:
    """Cells of a shortest way, or None where the goal can't be reached."""
    free = lambda c: 0 <= c[0] < column and 0 <= c[1] < row and c not in barriers
    if not free(start) or not free(goal):
        return None
    guess = (lambda c: abs(c[0] - goal[0]) + abs(c[1] - goal[1])) if heuristic == "Manhattan" else (lambda c: ((c[0] - goal[0]) ** 2 + (c[1] - goal[1]) ** 2) ** 0.5)
    cost, came, heap = {start: 0}, {}, [(guess(start), 0, start)]
    while heap:
        _, d, at = heapq.heappop(heap)
        if at == goal:
            way = [at]
            while at in came:
                at = came[at]
                way.append(at)
            return way[::-1]
        if d > cost[at]:
            continue
        for step in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            to = (at[0] + step[0], at[1] + step[1])
            if free(to) and d + 1 < cost.get(to, 1 << 60):
                cost[to], came[to] = d + 1, at
                heapq.heappush(heap, (d + 1 + guess(to), d + 1, to))
    return None


def distances_from(column: int, row: int, barriers: set[tuple[int, int]], start: tuple[int, int]) -> np.ndarray:
    """Moves from one cell to every cell by frontier sweeps; -1 where unreachable."""
    open_ = np.ones((column, row), bool)
    for c, r in barriers:
        if 0 <= c < column and 0 <= r < row:
            open_[c, r] = False
    out = np.full((column, row), -1)
    front = np.zeros_like(open_)
    if not (0 <= start[0] < column and 0 <= start[1] < row) or not open_[start]:
        return out
    front[start] = True
    d = 0
    while front.any():
        out[front] = d
        near = np.zeros_like(front)
        near[1:] |= front[:-1]
        near[:-1] |= front[1:]
        near[:, 1:] |= front[:, :-1]
        near[:, :-1] |= front[:, 1:]
        front = near & open_ & (out < 0)
        d += 1
    return out


#: Grids of so many cells have all their distances in one small table (a quarter of a million at most).
TABLE_CELLS = 512


def _between(column: int, row: int, closed: set[tuple[int, int]]) -> np.ndarray:
    """Moves between all cells, numbered as `cell` does; -1 where there is no way."""
    return np.array([distances_from(column, row, closed, (c, r)).ravel() for c in range(column) for r in range(row)])


def cell(loc: Column, column: int, row: int) -> Column:
    """The number of a location's cell, NULL outside the grid."""
    x, y = loc.x.cast("int"), loc.y.cast("int")
    return F.when(x.between(0, column - 1) & y.between(0, row - 1), x * row + y)


def ways(spark: SparkSession, column: int, row: int, barriers: list[tuple[int, int]]) -> DataFrame:
    """(_cell, _ways): for each cell the moves to every cell, NULL where there is no way."""
    closed = {tuple(map(int, b)) for b in barriers}
    rows = [(i, [float(v) if v >= 0 else None for v in to]) for i, to in enumerate(_between(column, row, closed).tolist())]
    return spark.createDataFrame(rows, "_cell int, _ways array<double>")


def _looked_up(pairs: DataFrame, column: int, row: int, closed: set[tuple[int, int]]) -> DataFrame:
    """Column dist from a broadcast table with one row for each two cells that reach each other."""
    moves = _between(column, row, closed).ravel()
    at = np.flatnonzero(moves >= 0)
    table = pairs.sparkSession.createDataFrame(list(zip(at.tolist(), moves[at].astype(float).tolist(), strict=True)), "_ends long, dist double")
    ends = (cell(F.col(c), column, row).cast("long") for c in ("src_loc", "dst_loc"))
    met = pairs.withColumn("_ends", next(ends) * (column * row) + next(ends)).join(F.broadcast(table), "_ends", "left")
    return met.select(*pairs.columns, "dist")


def with_paths(pairs: DataFrame, column: int, row: int, barriers: list[tuple[int, int]], path: bool) -> DataFrame:
    """Column dist (moves, NULL where unreachable) and path for src_loc and dst_loc; one sweep for each distinct source of a batch."""
    closed = {tuple(map(int, b)) for b in barriers}
    if not path and column * row <= TABLE_CELLS:
        return _looked_up(pairs, column, row, closed)
    schema = StructType.fromJson(pairs.schema.jsonValue()).add("dist", "double")
    if path:
        schema = schema.add("path", pairs.sparkSession.sql(f"select cast(null as {POLY}) p").schema[0].dataType)

    def run(batches):
        for pdf in batches:
            whole = lambda p: (int(p["x"]), int(p["y"]))
            src, dst = [whole(p) for p in pdf["src_loc"]], [whole(p) for p in pdf["dst_loc"]]
            fields = {s: distances_from(column, row, closed, s) for s in set(src)}
            inside = lambda c: 0 <= c[0] < column and 0 <= c[1] < row
            d = [fields[s][t] if inside(t) else -1 for s, t in zip(src, dst, strict=True)]
            pdf = pdf.assign(dist=[float(v) if v >= 0 else None for v in d])
            if path:
                pdf["path"] = [[{"x": float(x), "y": float(y)} for x, y in way] if (way := a_star(column, row, closed, s, t)) else None for s, t in zip(src, dst, strict=True)]
            yield pdf

    return pairs.mapInPandas(run, schema)


def grid_distance(df: DataFrame, column: int, row: int, barriers: list[tuple[int, int]], src: str = "src_loc", dst: str = "dst_loc", path: bool = False) -> DataFrame:
    return with_paths(df.withColumn("src_loc", F.col(src)).withColumn("dst_loc", F.col(dst)), column, row, barriers, path)

