"""Shortest ways around polygons: visibility graph and Dijkstra."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.shapes import POLY

EPS = 1e-9
Ring = list[tuple[float, float]]


def _cross(o, p, q) -> float:
    return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])


def _strictly_inside(ring: Ring, p) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if abs(_cross(a, b, p)) < 1e-7 and min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS:
            return False
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            inside = not inside
    return inside


def visible(p, q, rings: list[Ring]) -> bool:
    """Whether the open segment pq passes through no polygon's interior; touching is allowed."""
    for ring in rings:
        at = {0.0, 1.0}
        dx, dy = q[0] - p[0], q[1] - p[1]
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ex, ey = b[0] - a[0], b[1] - a[1]
            det = dx * ey - dy * ex
            if abs(det) > EPS:
                t = ((a[0] - p[0]) * ey - (a[1] - p[1]) * ex) / det
                u = ((a[0] - p[0]) * dy - (a[1] - p[1]) * dx) / det
                if -EPS <= u <= 1 + EPS and 0 < t < 1:
                    at.add(t)
        cuts = sorted(at)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1e-9 and _strictly_inside(ring, (p[0] + (lo + hi) / 2 * dx, p[1] + (lo + hi) / 2 * dy)):
                return False
    return True


def visibility_graph(rings: list[Ring]) -> dict[tuple, list[tuple]]:
    """Vertex -> vertices it sees; each pair is tested once."""
    points = [v for r in rings for v in r]
    graph: dict[tuple, list[tuple]] = {p: [] for p in points}
    for i, p in enumerate(points):
        for q in points[:i]:
            if p != q and visible(p, q, rings):
                graph[p].append(q)
                graph[q].append(p)
    return graph


def shortest(p, q, rings: list[Ring], graph: dict[tuple, list[tuple]] | None = None) -> tuple[float, list[tuple]] | None:
    """Length and points of the shortest way; None where an end lies strictly inside a polygon."""
    if any(_strictly_inside(r, p) or _strictly_inside(r, q) for r in rings):
        return None
    if visible(p, q, rings):
        return math.dist(p, q), [p, q]
    graph = graph if graph is not None else visibility_graph(rings)
    last = {v for v in graph if visible(v, q, rings)}
    heap, best, came = [(0.0, p)], {p: 0.0}, {}
    while heap:
        d, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        if at == q:
            way = [q]
            while way[-1] in came:
                way.append(came[way[-1]])
            return d, way[::-1]
        near = [v for v in graph if visible(at, v, rings)] if at == p else list(graph[at])
        if at in last:
            near.append(q)
        for v in near:
            e = d + math.dist(at, v)
            if e < best.get(v, math.inf):
                best[v], came[v] = e, at
                heapq.heappush(heap, (e, v))
    return None


def ways_from(p, ends: list, rings: list[Ring], graph: dict[tuple, list[tuple]]) -> dict[tuple, tuple[float, list[tuple]] | None]:
    """Length and points of the shortest way from p to each of the ends, by one search over the corners."""
    if any(_strictly_inside(r, p) for r in rings):
        return dict.fromkeys(ends)
    heap, best, came = [(0.0, p)], {p: 0.0}, {}
    while heap:
        d, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        for v in [v for v in graph if visible(at, v, rings)] if at == p else graph[at]:
            e = d + math.dist(at, v)
            if e < best.get(v, math.inf):
                best[v], came[v] = e, at
                heapq.heappush(heap, (e, v))
    out = {}
    for q in ends:
        if any(_strictly_inside(r, q) for r in rings):
            out[q] = None
        elif visible(p, q, rings):
            out[q] = math.dist(p, q), [p, q]
        else:
            near = [(best[v] + math.dist(v, q), v) for v in best if v != p and visible(v, q, rings)]
            if not near:
                out[q] = None
                continue
            total, at = min(near)
            way = [q, at]
            while way[-1] in came:
                way.append(came[way[-1]])
            out[q] = total, way[::-1]
    return out


def with_paths(pairs: DataFrame, polygons: list[Ring], path: bool) -> DataFrame:
    """Column dist (NULL where an end lies inside) and path for src_loc and dst_loc around constant polygons; one search for each distinct source of a batch."""
    rings = [[(float(x), float(y)) for x, y in r] for r in polygons]
    graph = visibility_graph(rings)
    schema = StructType.fromJson(pairs.schema.jsonValue()).add("dist", "double")
    if path:
        schema = schema.add("path", pairs.sparkSession.sql(f"select cast(null as {POLY}) p").schema[0].dataType)

    def run(batches):
        for pdf in batches:
            src, dst = ([(p["x"], p["y"]) for p in pdf[c]] for c in ("src_loc", "dst_loc"))
            ends: dict[tuple, dict] = {}
            for p, q in zip(src, dst, strict=True):
                ends.setdefault(p, {})[q] = None
            ways = {p: ways_from(p, list(qs), rings, graph) for p, qs in ends.items()}
            found = [ways[p][q] for p, q in zip(src, dst, strict=True)]
            pdf = pdf.assign(dist=[f[0] if f else None for f in found])
            if path:
                pdf["path"] = [[{"x": x, "y": y} for x, y in f[1]] if f else None for f in found]
            yield pdf

    return pairs.mapInPandas(run, schema)
