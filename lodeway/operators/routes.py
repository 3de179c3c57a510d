"""Route solvers over instance tables: one instance is one group of an Arrow task.

Input rows: instance_id, node_id, x, y and what the solver needs.  The parallel
unit is the instance (or instance x seed); one tour is never cut over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SolverNotAvailableError, UnsupportedInputError
from ..solvers import grid, obstacles, routing, touring, tsp

ROUTE = "instance_id long, method string, ofv double, dist double, seq array<long>"
#: With a lower bound of the objective, the gap to it and whether the solution is known to be the best.
BOUNDED = ROUTE + ", lower_bound double, gap double, solution string"
EARTH = 6378137.0
#: Constructions that need a row of the matrix at a time only, not the matrix; the improvements look at near nodes.
BY_ROWS = ("Insertion", "RandomInsertion", "NearestNeighbor", "FarthestNeighbor", "Sweep", "Christofides", "Random")
ANNEALING = (None, "SA", "SimulatedAnnealing")


def lazy(pdf: pd.DataFrame, edges: str = "Euclidean", **o) -> np.ndarray | tsp.Lazy:
    """The cells of `matrix` without the matrix, where places alone give them."""
    xy = pdf[["x", "y"]].to_numpy(float)
    if edges == "Euclidean":
        return tsp.Lazy(xy, lambda x, y, u, v: np.sqrt((x - u) ** 2 + (y - v) ** 2), lambda z: lambda i, j: abs(z[i] - z[j]))
    if edges == "Manhattan":
        return tsp.Lazy(xy, lambda x, y, u, v: np.abs(x - u) + np.abs(y - v))
    return matrix(pdf, edges, **o)


def matrix(pdf: pd.DataFrame, edges: str = "Euclidean", **o) -> np.ndarray:
    xy = pdf[["x", "y"]].to_numpy(float)
    if edges == "Euclidean":
        return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    if edges == "Manhattan":
        return np.abs(xy[:, None] - xy[None]).sum(axis=2)
    if edges == "LatLon":
        lat, lon = np.radians(xy[:, 0]), np.radians(xy[:, 1])
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        return 2 * EARTH * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    if edges == "Grid":
        closed = {tuple(b) for b in o.get("barriers", [])}
        fields = [grid.distances_from(o["column"], o["row"], closed, (int(x), int(y))) for x, y in xy]
        return np.array([[f[int(x), int(y)] for x, y in xy] for f in fields], float)
    if edges == "EuclideanBarrier":
        rings = o["polygons"]
        graph = obstacles.visibility_graph(rings)
        return np.array([[obstacles.shortest(tuple(p), tuple(q), rings, graph)[0] if i != j else 0.0 for j, q in enumerate(xy)] for i, p in enumerate(xy)])
    if edges == "Dictionary":
        ids = pdf["node_id"].tolist()
        return np.array([[0.0 if i == j else o["tau"][i, j] for j in ids] for i in ids])
    raise UnsupportedInputError(f"unknown edges {edges}")


def _spread(df: DataFrame, *more: str) -> DataFrame:
    """Instances dealt over all shuffle partitions: their rows are few bytes but much work, so small partitions must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "instance_id", *more)


def _proof(value: float, lower: float | None) -> dict:
    """Columns of BOUNDED for a value and its lower bound (None: no bound is known)."""
    if lower is None:
        return {"lower_bound": None, "gap": None, "solution": "Feasible"}
    gap = max(0.0, value - lower) / max(abs(value), 1e-12)
    return {"lower_bound": min(lower, value), "gap": gap, "solution": "Optimal" if gap <= 1e-9 else "Feasible"}


def _depot(pdf: pd.DataFrame, depot) -> int:
    ids = pdf["node_id"].tolist()
    return 0 if depot is None else ids.index(depot)


def solve_tsp(nodes: DataFrame, depot=None, edges: str = "Euclidean", algo: str = "Heuristic", cons: str = "Insertion", impv: str | None = "2Opt", meta: str | None = None, seed: int = 0, k: int = 1, service_time: float = 0.0, **o) -> DataFrame:
    """One closed tour for each instance (node_id order is the tie-break; without a depot the lowest id).

    ofv is the length plus service times: `service_time` a node besides the
    depot, or the sum of a column service_time where there is one.  An exact run
    that stops at its node limit gives its best tour with lower_bound and gap.
    """
    has_service = "service_time" in nodes.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        rows_do = algo != "Exact" and (cons in BY_ROWS if algo == "Heuristic" or meta in ANNEALING else meta in ("GA", "GeneticAlgorithm"))
        d = (lazy if rows_do else matrix)(pdf, edges, **o)
        lower = None
        if algo == "Exact":
            tour, lower = tsp.exact(d, _depot(pdf, depot))
        else:
            tour = tsp.solve(d, pdf[["x", "y"]].to_numpy(float), _depot(pdf, depot), algo, cons, impv, meta, seed, k)
        length = tsp.cost(d, tour)
        extra = float(pdf["service_time"].sum()) if has_service else (len(pdf) - 1) * service_time
        name = algo if algo == "Exact" else f"{algo}:{meta or cons}"
        row = {"instance_id": pdf["instance_id"].iloc[0], "method": name, "ofv": length + extra, "dist": length, "seq": pdf["node_id"].to_numpy()[[*tour, tour[0]]].tolist()}
        return pd.DataFrame([row | _proof(length + extra, None if lower is None else lower + extra)])

    return _spread(nodes).groupBy("instance_id").applyInPandas(run, BOUNDED)


def solve_multistart(nodes: DataFrame, seeds: int, meta: str = "SA", **options) -> DataFrame:
    """Best of several seeds; every (instance, seed) is a task of its own, `min_by` picks."""
    many = nodes.crossJoin(nodes.sparkSession.range(seeds).withColumnRenamed("id", "seed"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        cons = options.get("cons", "RandomInsertion")
        rows_do = cons in BY_ROWS if meta in ANNEALING else meta in ("GA", "GeneticAlgorithm")
        d = (lazy if rows_do else matrix)(pdf, options.get("edges", "Euclidean"))
        tour = tsp.solve(d, pdf[["x", "y"]].to_numpy(float), _depot(pdf, options.get("depot")), "Metaheuristic", cons, None, meta, seed)
        length = tsp.cost(d, tour)
        return pd.DataFrame({"instance_id": [pdf["instance_id"].iloc[0]], "method": [f"{meta}:{seed}"], "ofv": [length], "dist": [length], "seq": [pdf["node_id"].to_numpy()[[*tour, tour[0]]].tolist()]})

    each = _spread(many, "seed").groupBy("instance_id", "seed").applyInPandas(run, ROUTE)
    best = each.groupBy("instance_id").agg(F.min(F.struct("ofv", "method", "dist", "seq")).alias("b"))
    return best.select("instance_id", "b.method", "b.ofv", "b.dist", "b.seq")


def route_rows(routes: DataFrame, nodes: DataFrame, speed: float = 1.0) -> DataFrame:
    """Stops of each route with location and time: (instance_id, pos, node_id, x, y, t)."""
    from .trajectories import with_mileage

    stops = routes.select("instance_id", F.posexplode("seq").alias("pos", "node_id")).join(nodes.select("instance_id", "node_id", "x", "y"), ["instance_id", "node_id"])
    return with_mileage(stops, ["instance_id"], ["pos"]).select("instance_id", "pos", "node_id", "x", "y", (F.col("mileage") / speed).alias("t"))


def solve_tsptw(nodes: DataFrame, depot=None, edges: str = "Euclidean", speed: float = 1.0, allow_violation: bool = False) -> DataFrame:
    """Tours with time windows (columns lo, hi, service_time); NULL seq where none is feasible.

    With allow_violation the most valuable set of nodes (column value, else 1
    each) that can be served in time is visited; `unvisited` lists the others.
    """
    has_value = "value" in nodes.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        d, w, s, at = matrix(pdf, edges), pdf[["lo", "hi"]].to_numpy(float), pdf["service_time"].to_numpy(float), _depot(pdf, depot)
        ids = pdf["node_id"].to_numpy()
        if allow_violation:
            value = pdf["value"].to_numpy(float) if has_value else np.ones(len(pdf))
            gained, _, order = routing.tsptw_violation(d, w, s, value, at, 0.0, speed)
            found = (gained, order)
        else:
            found = routing.tsptw(d, w, s, at, 0.0, speed)
        row = {"instance_id": pdf["instance_id"].iloc[0], "method": "violation" if allow_violation else "hard", "ofv": None, "dist": None, "seq": None}
        if found is not None:
            row |= {"ofv": found[0], "dist": tsp.cost(d, found[1]), "seq": ids[[*found[1], found[1][0]]].tolist()}
        row["unvisited"] = ids[[i for i in range(len(ids)) if found is None or i not in found[1]]].tolist()
        return pd.DataFrame([row])

    return nodes.groupBy("instance_id").applyInPandas(run, ROUTE + ", unvisited array<long>")


def solve_op(nodes: DataFrame, budget: float, start=None, end=None, edges: str = "Euclidean") -> DataFrame:
    """Most price (column price) from start to end within the budget; NULL seq where the budget is too small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        a, b = _depot(pdf, start), _depot(pdf, end) if end is not None else _depot(pdf, start)
        found = routing.orienteering(matrix(pdf, edges), pdf["price"].to_numpy(float), budget, a, b)
        row = {"instance_id": pdf["instance_id"].iloc[0], "method": "exact", "ofv": None, "dist": None, "seq": None}
        if found is not None:
            row |= {"ofv": found[0], "dist": found[1], "seq": pdf["node_id"].to_numpy()[found[2]].tolist()}
        return pd.DataFrame([row])

    return nodes.groupBy("instance_id").applyInPandas(run, ROUTE)


def solve_top(*_args, **_options) -> DataFrame:
    raise SolverNotAvailableError("the team orienteering problem is not available")


def solve_vrptw(nodes: DataFrame, vehicles: int, capacity: float, depot=None, edges: str = "Euclidean", speed: float = 1.0) -> DataFrame:
    """Routes with windows (lo, hi, service_time) and demand: one row for each route; none where infeasible.

    Up to routing.PARTITION_LIMIT customers the least total length; beyond, routes
    by insertion and moves with lower_bound and gap of the total, and none where
    the insertion finds no place for a customer.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        d = matrix(pdf, edges)
        solver = routing.vrptw if len(pdf) <= routing.PARTITION_LIMIT + 1 else routing.vrptw_bounded
        found = solver(d, pdf["demand"].to_numpy(float), pdf[["lo", "hi"]].to_numpy(float), pdf["service_time"].to_numpy(float), capacity, vehicles, _depot(pdf, depot), speed)
        ids = pdf["node_id"].to_numpy()
        rows = [] if found is None else [{"instance_id": pdf["instance_id"].iloc[0], "method": f"route:{i}", "ofv": found[0], "dist": tsp.cost(d, r), "seq": ids[[*r, r[0]]].tolist()} | _proof(found[0], found[2] if len(found) > 2 else found[0]) for i, r in enumerate(found[1])]
        return pd.DataFrame(rows, columns=["instance_id", "method", "ofv", "dist", "seq", "lower_bound", "gap", "solution"])

    return nodes.groupBy("instance_id").applyInPandas(run, BOUNDED)


def solve_mtsp(nodes: DataFrame, vehicles: int, depot=None, edges: str = "Euclidean", cons: str = "Insertion", improve: bool = True, seed: int = 0) -> DataFrame:
    """Tours of several vehicles with a small longest one: a row for each vehicle; ofv is the longest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        d = lazy(pdf, edges)
        tours = routing.multi_tour(d, pdf[["x", "y"]].to_numpy(float), vehicles, _depot(pdf, depot), cons, improve, seed)
        ids, most = pdf["node_id"].to_numpy(), max(tsp.cost(d, t) for t in tours)
        return pd.DataFrame([{"instance_id": pdf["instance_id"].iloc[0], "method": f"vehicle:{i}", "ofv": most, "dist": tsp.cost(d, t), "seq": ids[[*t, t[0]]].tolist()} for i, t in enumerate(tours)])

    return _spread(nodes).groupBy("instance_id").applyInPandas(run, ROUTE)


def solve_cetsp(nodes: DataFrame, start: tuple[float, float], end: tuple[float, float], neighbor: str = "Circle", algo: str = "Metaheuristic", seed: int = 0) -> DataFrame:
    """Close-enough tours: column radius (Circle) or poly (Poly); geographic kinds run in Mercator metres."""
    if neighbor not in ("Circle", "Poly", "CircleLatLon", "PolyLatLon"):
        raise UnsupportedInputError(f"unknown neighbourhood {neighbor}")

    def mercator(p):
        p = np.asarray(p, float)
        return np.stack([np.log(np.tan(np.pi / 4 + np.radians(p[..., 0]) / 2)) * EARTH, np.radians(p[..., 1]) * EARTH], axis=-1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", kind="stable").reset_index(drop=True)
        xy, s, e = pdf[["x", "y"]].to_numpy(float), np.asarray(start, float), np.asarray(end, float)
        scale = 1.0
        if neighbor.endswith("LatLon"):
            scale = 1 / np.cos(np.radians(xy[:, 0]))
            xy, s, e = mercator(xy), mercator(s), mercator(e)
        if neighbor.startswith("Circle"):
            total, order, _ = touring.close_enough(tuple(s), tuple(e), xy, pdf["radius"].to_numpy(float) * scale, algo=algo, seed=seed)
        else:
            rings = [np.array([(p["x"], p["y"]) for p in r]) for r in pdf["poly"]]
            rings = [mercator(r) for r in rings] if neighbor.endswith("LatLon") else rings
            total, order, _ = touring.close_enough(tuple(s), tuple(e), xy, rings=[[tuple(map(float, p)) for p in r] for r in rings], algo=algo, seed=seed)
        return pd.DataFrame({"instance_id": [pdf["instance_id"].iloc[0]], "method": [f"{neighbor}:{algo}"], "ofv": [total], "dist": [total], "seq": [pdf["node_id"].to_numpy()[order].tolist()]})

    return _spread(nodes).groupBy("instance_id").applyInPandas(run, ROUTE)


PATH = "instance_id long, dist double, path array<struct<x:double,y:double>>"


def touring_path(regions: DataFrame, start: tuple[float, float], end: tuple[float, float], kind: str = "circle") -> DataFrame:
    """Shortest way through regions in the order of seq: x, y, radius (circle) or poly (polygon)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        if kind == "circle":
            total, way = touring.touch_disks(np.asarray(start, float), np.asarray(end, float), pdf[["x", "y"]].to_numpy(float), pdf["radius"].to_numpy(float))
        elif kind == "polygon":
            total, way = touring.touch_rings(start, end, [[(p["x"], p["y"]) for p in r] for r in pdf["poly"]])
        else:
            raise UnsupportedInputError("kind must be circle or polygon")
        return pd.DataFrame({"instance_id": [pdf["instance_id"].iloc[0]], "dist": [total], "path": [[{"x": float(x), "y": float(y)} for x, y in way]]})

    return regions.groupBy("instance_id").applyInPandas(run, PATH)


def cone_path(cones: DataFrame, start: tuple[float, float, float], end: tuple[float, float, float], slope: float) -> DataFrame:
    """Shortest 3D way through cones (x, y, max_height) in the order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        total, way = touring.touch_cones(np.asarray(start, float), np.asarray(end, float), [{"center": (r.x, r.y), "max_height": r.max_height} for r in pdf.itertuples()], slope)
        return pd.DataFrame({"instance_id": [pdf["instance_id"].iloc[0]], "dist": [total], "path": [[{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in way]]})

    return _spread(cones).groupBy("instance_id").applyInPandas(run, "instance_id long, dist double, path array<struct<x:double,y:double,z:double>>")


def chase_path(targets: DataFrame, start: tuple[float, float], end: tuple[float, float], speed: float) -> DataFrame:
    """Meet moving targets (x, y, vx, vy) in the order of seq: (instance_id, t, path); NULL where one escapes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        found = touring.chase(np.asarray(start, float), np.asarray(end, float), [(np.array([r.x, r.y], float), np.array([r.vx, r.vy], float)) for r in pdf.itertuples()], speed)
        path = None if found is None else [{"x": float(p[0]), "y": float(p[1]), "t": float(t)} for p, t in found[1]]
        return pd.DataFrame({"instance_id": [pdf["instance_id"].iloc[0]], "t": [None if found is None else found[0]], "path": [path]})

    return targets.groupBy("instance_id").applyInPandas(run, "instance_id long, t double, path array<struct<x:double,y:double,t:double>>")


def service_plan(pieces: DataFrame, demand: DataFrame, max_speed: float, mode: str = "AccuOverlap") -> DataFrame:
    """Times on labelled pieces (route_id, lo, hi, polygons) that give each polygon its demand: (route_id, lo, hi, time)."""
    need = {r["poly_id"]: float(r["demand"]) for r in demand.select("poly_id", "demand").collect()}  # one row a polygon

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo", kind="stable")
        own = {p for held in pdf["polygons"] for p in held}
        times = touring.service_times([(float(r.hi - r.lo), set(r.polygons)) for r in pdf.itertuples()], {k: v for k, v in need.items() if k in own}, max_speed, mode)
        return pd.DataFrame({"route_id": pdf["route_id"], "lo": pdf["lo"], "hi": pdf["hi"], "time": times if times is not None else [None] * len(pdf)})

    return pieces.groupBy("route_id").applyInPandas(run, "route_id long, lo double, hi double, time double")
