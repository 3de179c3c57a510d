"""Solvers against brute force on small instances."""

import math
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from lodeway.errors import OutOfRangeError, SolverNotAvailableError, UnsupportedInputError
from lodeway.operators import routes
from lodeway.solvers import grid, obstacles, overlay, routing, touring, tsp


def instance(seed, n):
    xy = np.random.default_rng(seed).uniform(0, 100, (n, 2))
    return xy, np.linalg.norm(xy[:, None] - xy[None], axis=2)


def brute(d):
    return min(tsp.cost(d, [0, *q]) for q in permutations(range(1, len(d))))


@pytest.mark.parametrize("seed", range(4))
def test_tours(seed):
    xy, d = instance(seed, 8)
    best = brute(d)
    assert math.isclose(tsp.cost(d, tsp.held_karp(d)), best)
    assert math.isclose(tsp.cost(d, tsp.branch_and_bound(d)[0]), best)
    for name in ("Insertion", "RandomInsertion", "NearestNeighbor", "FarthestNeighbor", "Sweep", "Christofides", "Random"):
        t = tsp.construct(name, d, xy)
        assert sorted(t) == list(range(8)) and t[0] == 0
        better = tsp.or_opt(d, tsp.two_opt(d, t))
        assert best - 1e-9 <= tsp.cost(d, better) <= tsp.cost(d, t) + 1e-9
    for meta in ("SA", "GA"):
        t = tsp.solve(d, xy, algo="Metaheuristic", meta=meta, seed=seed)
        assert sorted(t) == list(range(8)) and tsp.cost(d, t) <= best * 1.1
    assert tsp.cost(d, tsp.christofides(d)) <= 1.5 * best + 1e-9


@pytest.mark.parametrize("seed", range(12))
def test_matching_is_least_beyond_14_nodes(seed):
    n, rng = 16, np.random.default_rng(seed)
    xy = rng.uniform(0, 100, (n, 2)) if seed % 2 else rng.integers(0, 5, (n, 2)).astype(float)
    w = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    least = {0: 0.0}
    for mask in range((1 << n) - 1):
        if mask in least:
            i = next(b for b in range(n) if not mask >> b & 1)
            for j in range(i + 1, n):
                if not mask >> j & 1:
                    to = mask | 1 << i | 1 << j
                    least[to] = min(least.get(to, math.inf), least[mask] + w[i, j])
    pairs = tsp.matching(w, list(range(n)))
    assert sorted(x for p in pairs for x in p) == list(range(n))
    assert math.isclose(sum(w[p] for p in pairs), least[(1 << n) - 1], abs_tol=1e-9)


def test_asymmetric_two_opt():
    d = np.random.default_rng(5).uniform(1, 100, (9, 9))
    t = tsp.two_opt(d, list(range(9)))
    assert sorted(t) == list(range(9)) and tsp.cost(d, t) <= tsp.cost(d, list(range(9)))


def test_square_tour():
    xy = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert tsp.cost(d, tsp.exact(d)[0]) == 40


def test_names():
    _, d = instance(0, 4)
    with pytest.raises(UnsupportedInputError):
        tsp.construct("Nothing", d)
    with pytest.raises(SolverNotAvailableError):
        tsp.construct("CycleCover", d)
    with pytest.raises(SolverNotAvailableError):
        routes.solve_top()
    with pytest.raises(OutOfRangeError):
        routing.orienteering(instance(0, 30)[1], np.ones(30), 10, 0, 1)


@pytest.mark.parametrize("seed", range(4))
def test_time_windows(seed):
    _, d = instance(seed, 6)
    rng = np.random.default_rng(seed)
    lo = rng.uniform(0, 100, 6)
    w = np.stack([lo, lo + 250], axis=1)
    w[0] = (0, 1e6)
    service = np.ones(6)

    def run(order):
        t = service[0]
        at = 0
        for j in order:
            t = max(t + d[at, j], w[j, 0])
            if t > w[j, 1]:
                return math.inf
            t += service[j]
            at = j
        return t + d[at, 0]

    best = min(run(q) for q in permutations(range(1, 6)))
    found = routing.tsptw(d, w, service)
    assert (found is None) == math.isinf(best)
    if found:
        assert math.isclose(found[0], best) and math.isclose(run(found[1][1:]), best)
    value, _, order = routing.tsptw_violation(d, w, service, np.ones(6))
    most = max(k for k in range(6) if any(not math.isinf(run(q)) for q in permutations(range(1, 6), k)))
    assert value == most == len(order) - 1


@pytest.mark.parametrize("seed", range(3))
def test_orienteering(seed):
    _, d = instance(seed, 7)
    price = np.random.default_rng(seed).integers(1, 9, 7).astype(float)
    best = max(price[[0, *q, 1]].sum() for k in range(6) for q in permutations(range(2, 7), k) if sum(d[a, b] for a, b in zip((0, *q), (*q, 1), strict=True)) <= 180) if d[0, 1] <= 180 else None
    found = routing.orienteering(d, price, 180, 0, 1)
    assert (found is None) == (best is None)
    if found:
        assert found[0] == best and found[1] <= 180 + 1e-9


def test_vehicle_routes():
    _, d = instance(2, 6)
    demand, service = np.array([0, 2, 2, 2, 2, 2.0]), np.zeros(6)
    w = np.tile([0, 1e6], (6, 1))
    total, tours = routing.vrptw(d, demand, w, service, 4, 3)

    def parts(items):
        if not items:
            yield []
            return
        a, rest = items[0], items[1:]
        for k in range(len(rest) + 1):
            for q in permutations(rest, k):
                if k <= 1:
                    for tail in parts([x for x in rest if x not in q]):
                        yield [[a, *q], *tail]

    best = min(sum(min(tsp.cost(d, [0, *o]) for o in permutations(r)) for r in p) for p in parts([1, 2, 3, 4, 5]) if len(p) <= 3)
    assert math.isclose(total, best)
    assert sorted(x for t in tours for x in t if x) == [1, 2, 3, 4, 5]
    assert routing.vrptw(d, demand, w, service, 1, 3) is None


def test_many_vehicles():
    xy, d = instance(3, 12)
    for cons in ("Insertion", "RandomInsertion", "Sweep", "Random"):
        tours = routing.multi_tour(d, xy, 3, cons=cons)
        assert sorted(x for t in tours for x in t if x) == list(range(1, 12)) and all(t[0] == 0 for t in tours)


def test_touring_disks():
    s, e = np.array([0.0, 0.0]), np.array([10.0, 0.0])
    assert math.isclose(touring.touch_disks(s, e, np.array([[5.0, 3.0]]), np.array([3.0]))[0], 10)
    total, way = touring.touch_disks(s, e, np.array([[5.0, 5.0]]), np.array([1.0]))
    assert math.isclose(total, 2 * math.hypot(5, 4), rel_tol=1e-6) and math.isclose(way[1][1], 4, rel_tol=1e-5)
    c = np.array([[2.0, 8.0], [8.0, 8.0], [5.0, -6.0]])
    r = np.ones(3)
    best = min(touring.touch_disks(s, e, c[list(o)], r)[0] for o in permutations(range(3)))
    assert math.isclose(touring.close_enough_exact((0, 0), (10, 0), c, r)[0], best, rel_tol=1e-6)
    assert touring.close_enough_genetic((0, 0), (10, 0), c, r)[0] <= best * 1.05


def test_touring_polygons_cones_targets():
    total, way = touring.touch_rings((0, 0), (10, 0), [[(4, 3), (6, 3), (6, 5), (4, 5)]])
    assert math.isclose(total, 2 * math.hypot(5, 3), rel_tol=1e-4) and len(way) == 3
    flat, _ = touring.touch_cones(np.zeros(3), np.array([10.0, 0, 0]), [{"center": (5, 0), "max_height": 5}], 0.5)
    assert math.isclose(flat, 10, rel_tol=1e-6)
    t, stops = touring.chase(np.zeros(2), np.array([20.0, 0]), [(np.array([10.0, 0]), np.array([0.5, 0]))], 1.0)
    assert math.isclose(t, 20) and math.isclose(stops[1][1], 20)
    assert touring.chase(np.zeros(2), np.zeros(2), [(np.array([10.0, 0]), np.array([2.0, 0]))], 1.0) is None


def best_over_samples(start, end, rings, sides=30):
    """Least way through one sampled point of each ring in any order, by subsets, and its order."""
    pts = [np.array([np.add(a, np.multiply(np.subtract(b, a), k / sides)) for a, b in zip(r, [*r[1:], r[0]], strict=True) for k in range(sides)]) for r in rings]
    n = len(rings)
    gap = {(i, j): np.linalg.norm(pts[i][:, None] - pts[j][None], axis=2) for i in range(n) for j in range(n) if i != j}
    state = {(1 << i, i): np.linalg.norm(pts[i] - start, axis=1) for i in range(n)}
    order = {key: [[key[1]]] * len(pts[key[1]]) for key in state}
    for mask in range(1, 1 << n):
        for i in range(n):
            if (mask, i) in state:
                for j in range(n):
                    if not mask >> j & 1:
                        w = state[mask, i][:, None] + gap[i, j]
                        pick, to = w.argmin(axis=0), (mask | 1 << j, j)
                        value, way = w.min(axis=0), [[*order[mask, i][p], j] for p in pick]
                        if to in state:
                            old = state[to]
                            way = [a if x <= y else b for x, y, a, b in zip(old, value, order[to], way, strict=True)]
                            value = np.minimum(old, value)
                        state[to], order[to] = value, way
    full = (1 << n) - 1
    return min((float(v), order[full, i][k]) for i in range(n) for k, v in enumerate(state[full, i] + np.linalg.norm(pts[i] - end, axis=1)))


@pytest.mark.parametrize("seed", range(3))
def test_close_enough_rings_exact(seed):
    rng = np.random.default_rng(seed)
    rings = []
    for x, y in rng.uniform(0, 100, (7, 2)):
        a, b = rng.uniform(3, 40, 2)
        rings.append([(x, y), (x + a, y), (x + a, y + b), (x, y + b)])
    mid = np.array([np.mean(r, axis=0) for r in rings])
    bound, order = best_over_samples((0, 0), (100, 0), rings)
    want = touring.touch_rings((0, 0), (100, 0), [rings[i] for i in order])[0]
    total, found, way = touring.close_enough((0, 0), (100, 0), mid, rings=rings, algo="Exact")
    assert total <= min(want, bound) + 1e-5 and sorted(found) == list(range(7)) and len(way) == 9
    assert total >= bound - sum(2 * (r[2][0] - r[0][0] + r[2][1] - r[0][1]) for r in rings) / 60
    assert math.isclose(total, np.linalg.norm(np.diff(way, axis=0), axis=1).sum())
    assert total - 1e-5 <= touring.close_enough((0, 0), (100, 0), mid, rings=rings)[0] <= total * 1.05
    with pytest.raises(UnsupportedInputError):
        touring.close_enough((0, 0), (100, 0), mid, rings=rings, algo="Nothing")


def test_service_times():
    times = touring.service_times([(10, {1}), (5, {1, 2}), (5, {2})], {1: 12.0, 2: 8.0}, 1.0)
    assert times[0] + times[1] >= 12 - 1e-9 and times[1] + times[2] >= 8 - 1e-9 and all(t >= n - 1e-9 for t, n in zip(times, (10, 5, 5), strict=True))
    assert touring.service_times([(1, set())], {1: 2.0}, 1.0) is None


def test_grid():
    way = grid.a_star(3, 3, {(1, 0), (1, 1)}, (0, 0), (2, 0))
    assert len(way) - 1 == 6 == grid.distances_from(3, 3, {(1, 0), (1, 1)}, (0, 0))[2, 0]
    assert grid.a_star(3, 1, {(1, 0)}, (0, 0), (2, 0)) is None


def test_obstacles():
    box = [(4.0, -1.0), (6.0, -1.0), (6.0, 1.0), (4.0, 1.0)]
    length, way = obstacles.shortest((0, 0), (10, 0), [box])
    assert math.isclose(length, 2 * math.hypot(4, 1) + 2) and len(way) == 4
    assert obstacles.shortest((5, 0), (10, 0), [box]) is None
    assert obstacles.shortest((0, 5), (10, 5), [box])[0] == 10


def test_overlay():
    a, b = [(0, 0), (10, 0), (10, 10), (0, 10)], [(5, 5), (15, 5), (15, 15), (5, 15)]
    size = lambda rings: sum(abs(overlay.signed_area(r)) for r in rings)
    assert math.isclose(size(overlay.union([a, b])), 175)
    assert math.isclose(size(overlay.intersection([a, b])), 25)
    assert math.isclose(size(overlay.difference([a], [b])), 75)
    assert overlay.intersection([a, [(20, 20), (30, 20), (30, 30)]]) == []
    side = [(10, 0), (20, 0), (20, 10), (10, 10)]
    assert len(overlay.union([a, side])) == 1 and math.isclose(size(overlay.union([a, side])), 200)
    assert math.isclose(size(overlay.triangles([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)])), 60)


@settings(max_examples=40, deadline=None)
@given(hs.lists(hs.tuples(hs.integers(-20, 20), hs.integers(-20, 20), hs.integers(2, 9), hs.integers(2, 9)), min_size=2, max_size=4))
def test_overlay_areas(boxes):
    rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in boxes]
    cells = [{(i, j) for i in range(x, x + w) for j in range(y, y + h)} for x, y, w, h in boxes]
    size = lambda rs: sum(overlay.signed_area(r) for r in rs)
    assert math.isclose(size(overlay.intersection(rings)), len(set.intersection(*cells)), abs_tol=1e-6)
    if not any(math.isclose(size(overlay.union(rings)), len(set.union(*cells)), abs_tol=1e-6) for _ in (0,)):
        assert size(overlay.union(rings)) >= len(set.union(*cells))  # outer rings count holes


@pytest.mark.parametrize("seed", range(3))
def test_exact_tour_of_thirty_nodes(seed):
    """The bound of a search that ended is its tour; a stopped one gives both."""
    _, d = instance(seed, 30)
    tour, lower = tsp.branch_and_bound(d, 0, 30_000)
    length = tsp.cost(d, tour)
    assert sorted(tour) == list(range(30)) and 0.97 * length <= lower <= length + 1e-9
    assert length <= tsp.cost(d, tsp.or_opt(d, tsp.two_opt(d, tsp.nearest_neighbour(d)))) + 1e-9
    stopped, low = tsp.branch_and_bound(d, 0, 5)
    assert low <= length + 1e-9 <= tsp.cost(d, stopped) + 2e-9


@pytest.mark.parametrize("seed", range(3))
def test_node_prices_bound_from_below(seed):
    _, d = instance(seed, 9)
    best = tsp.cost(d, tsp.held_karp(d))
    price, lower = tsp.ascent(d, 0, best)
    assert 0.95 * best <= lower <= best + 1e-9 and len(price) == 9
    assert math.isclose(tsp.cost(d, tsp.branch_and_bound(d)[0]), best)


def test_orienteering_of_twenty_nodes():
    _, d = instance(1, 20)
    price = np.random.default_rng(1).integers(1, 99, 20).astype(float)
    found = routing.orienteering(d, price, 200, 4, 2)
    assert found[1] <= 200 + 1e-9 and found[2][0] == 4 and found[2][-1] == 2 and len(set(found[2])) == len(found[2])
    assert math.isclose(found[0], price[found[2]].sum()) and math.isclose(found[1], sum(d[a, b] for a, b in zip(found[2], found[2][1:], strict=False)))


def test_time_windows_without_other_nodes():
    d, w = np.zeros((1, 1)), np.array([[0.0, 10.0]])
    assert routing.tsptw(d, w, np.ones(1)) == (1.0, [0])
    assert routing.tsptw_violation(d, w, np.ones(1), np.ones(1)) == (0.0, 1.0, [0])


def test_vehicle_routes_of_thirty_customers():
    _, d = instance(3, 31)
    rng = np.random.default_rng(3)
    lo = rng.uniform(0, 300, 31)
    w = np.stack([lo, lo + 200], axis=1)
    w[0] = (0, 1e4)
    demand, service = rng.integers(1, 9, 31).astype(float), np.ones(31)
    total, tours, lower = routing.vrptw_bounded(d, demand, w, service, 40, 30)
    assert sorted(i for t in tours for i in t[1:]) == list(range(1, 31)) and all(t[0] == 0 for t in tours)
    assert all(sum(demand[t]) - demand[0] <= 40 and not routing._late(d, t[1:], w, service, 0, 1.0) for t in tours)
    assert math.isclose(total, sum(tsp.cost(d, t) for t in tours)) and 0 < lower <= total
    small = instance(5, 7)[1]
    exact = routing.vrptw(small, demand[:7], w[:7], service[:7], 12, 6)
    near = routing.vrptw_bounded(small, demand[:7], w[:7], service[:7], 12, 6)
    assert near[2] <= exact[0] + 1e-9 <= near[0] + 2e-9


def test_free_triangles_cover_the_rest():
    rings = [[(20.0, 20.0), (60.0, 20.0), (60.0, 60.0), (40.0, 30.0), (20.0, 60.0)], [(50.0, 10.0), (90.0, 50.0), (50.0, 90.0)], [(-10.0, 40.0), (30.0, 40.0), (30.0, 45.0), (-10.0, 45.0)]]
    parts = overlay.free_triangles((0.0, 100.0, 0.0, 100.0), rings)
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 100, (4000, 2))
    for x, y in points:
        free = not any(overlay.contains(r, x, y) for r in rings)
        assert sum(overlay.contains(t, x, y) for t in parts) == free
    assert overlay.free_triangles((0.0, 1.0, 0.0, 1.0), [[(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]]) == []


def test_constructions_by_rows_equal_the_full_matrix():
    import pandas as pd

    from lodeway.operators import routes

    rng = np.random.default_rng(5)
    for n, side in ((1, 9), (2, 9), (60, 7), (200, 1000)):
        pdf = pd.DataFrame(rng.integers(0, side, (n, 2)).astype(float), columns=["x", "y"])
        for edges in ("Euclidean", "Manhattan"):
            d, rows = routes.matrix(pdf, edges), routes.lazy(pdf, edges)
            assert isinstance(rows, tsp.Lazy) and len(rows) == n
            for name in routes.BY_ROWS:
                tour = tsp.construct(name, d, pdf.to_numpy(), n - 1, 3)
                assert tour == tsp.construct(name, rows, pdf.to_numpy(), n - 1, 3) and sorted(tour) == list(range(n))
                assert tsp.cost(rows, tour) == tsp.cost(d, tour)


def test_constructions_hold_no_matrix(monkeypatch):
    import pandas as pd

    from lodeway.operators import routes

    monkeypatch.setattr(routes, "matrix", None)
    rows = routes.lazy(pd.DataFrame({"x": np.arange(30_000.0), "y": 0.0}))
    assert tsp.nearest_neighbour(rows) == list(range(30_000))


def test_touching_is_done_on_plain_numbers(monkeypatch):
    # arrays of two or three cost twenty times as much; a full search of six disks called them about two million times
    calls = []
    norm = np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda *a, **k: calls.append(1) or norm(*a, **k))
    c = np.random.default_rng(1).random((6, 2)) * 100
    total, order, way = touring.close_enough((0, 0), (100, 100), c, np.full(6, 5.0))
    assert sorted(order) == list(range(6)) and len(way) == 8
    touring.touch_cones(np.zeros(3), np.array([100.0, 0, 0]), [{"center": tuple(p), "max_height": 10.0} for p in c], 0.5)
    assert len(calls) < 100
    for i, p in zip(order, way[1:-1], strict=True):
        assert norm(p - c[i]) <= 5 + 1e-9


@pytest.mark.parametrize("edges", ["Euclidean", "Manhattan"])
@pytest.mark.parametrize("n", [2, 3, 5, 9, 60, 200])
def test_improvements_by_near_nodes_equal_those_by_the_matrix(n, edges):
    import pandas as pd

    from lodeway.operators import routes

    rng = np.random.default_rng(n)
    for xy in (rng.uniform(0, 100, (n, 2)), rng.integers(0, 6, (n, 2)).astype(float)):
        pdf = pd.DataFrame(xy, columns=["x", "y"])
        d, near = routes.matrix(pdf, edges), routes.lazy(pdf, edges)
        for t in (tsp.random_tour(d, 0, 3), tsp.insertion(d)):
            assert tsp.two_opt(near, t) == tsp.two_opt(d, t)
            assert tsp.or_opt(near, tsp.two_opt(near, t)) == tsp.or_opt(d, tsp.two_opt(d, t))
        assert tsp.genetic(near, seed=2, generations=20) == tsp.genetic(d, seed=2, generations=20)


@pytest.mark.parametrize("options", [{"cons": "Insertion", "impv": "2Opt+OrOpt"}, {"algo": "Metaheuristic", "meta": "GA"}])
def test_tours_need_no_matrix(monkeypatch, options):
    import pandas as pd

    from lodeway.operators import routes

    monkeypatch.setattr(routes, "matrix", None)
    grouped = type("G", (), {"applyInPandas": lambda self, run, schema: run(pd.DataFrame({"instance_id": 1, "node_id": range(20), "x": [i * 7 % 11 for i in range(20)], "y": [i * 5 % 13 for i in range(20)]}))})()
    monkeypatch.setattr(routes, "_spread", lambda nodes: type("N", (), {"groupBy": lambda self, key: grouped})())
    out = routes.solve_tsp(type("N", (), {"columns": []})(), **options)
    assert sorted(out["seq"].iloc[0][:-1]) == list(range(20))


@pytest.mark.parametrize("n", [4, 5, 9, 60])
@pytest.mark.parametrize("even", [True, False])
def test_annealing_adds_up_its_moves(n, even, monkeypatch):
    rng = np.random.default_rng(n)
    d = rng.uniform(1, 9, (n, n))
    d = d + d.T if even else d
    calls, whole = [], tsp.cost
    monkeypatch.setattr(tsp, "cost", lambda d, t: calls.append(whole(d, t)) or calls[-1])
    t = tsp.simulated_annealing(d, list(range(n)), 1, start=5.0, end=4.0, cooling=0.9)
    assert sorted(t) == list(range(n)) and t[0] == 0 and whole(d, t) <= whole(d, list(range(n)))
    assert len(calls) < 10 and whole(d, t) <= min(calls) + 1e-6


def test_tails_are_exchanged_by_sums_of_ways():
    rng = np.random.default_rng(8)
    for n in (3, 4, 7, 12, 30):
        for d in (rng.uniform(1, 9, (n, n)), routes.lazy(__import__("pandas").DataFrame(rng.uniform(0, 9, (n, 2)), columns=["x", "y"]))):
            rest = rng.permutation(np.arange(1, n)).tolist()
            a, b = [0, *rest[: n // 2]], [0, *rest[n // 2 :]]
            worst, want = max(tsp.cost(d, a), tsp.cost(d, b)), None
            for i in range(1, len(a) + 1):
                for j in range(1, len(b) + 1):
                    if want is None and max(tsp.cost(d, a[:i] + b[j:]), tsp.cost(d, b[:j] + a[i:])) < worst - 1e-9:
                        want = (i, j)
            assert routing._shorter_tails(d, np.array(a), np.array(b), cells=20) == want


def test_several_vehicles_need_no_matrix():
    import pandas as pd

    xy = np.random.default_rng(3).uniform(0, 100, (70, 2))
    pdf = pd.DataFrame(xy, columns=["x", "y"])
    for cons in ("Insertion", "RandomInsertion", "Sweep", "Random"):
        assert routing.multi_tour(routes.lazy(pdf), xy, 3, cons=cons, seed=1) == routing.multi_tour(routes.matrix(pdf), xy, 3, cons=cons, seed=1)


@pytest.mark.parametrize("seed", range(6))
def test_matching_by_near_places_is_that_of_the_matrix(seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 100, (16, 2)) if seed % 2 else np.concatenate([rng.integers(0, 4, (8, 2)), rng.integers(40, 43, (8, 2))]).astype(float)
    pdf = pd.DataFrame(xy, columns=["x", "y"])
    d, near = routes.matrix(pdf), routes.lazy(pdf)
    nodes = list(range(16))
    assert math.isclose(sum(d[p] for p in tsp.matching(near, nodes)), sum(d[p] for p in tsp.matching(d, nodes)), abs_tol=1e-9)


def test_christofides_needs_no_matrix_and_matches_thousands_of_nodes(monkeypatch):
    """the matching was O(n^3), so 3,600 nodes did not end within minutes."""
    import time

    xy = np.random.default_rng(20).uniform(0, 100, (4000, 2))
    near, began = tsp.Lazy(xy, lambda x, y, u, v: np.sqrt((x - u) ** 2 + (y - v) ** 2)), time.perf_counter()
    tour = tsp.christofides(near)
    assert sorted(tour) == list(range(4000)) and time.perf_counter() - began < 30
    # a tree is shorter than any tour, and the matching at most half of one
    tree = sum(float(near[e]) for e in tsp._spanning_tree(near, 0))
    assert tsp.cost(near, tour) < 1.5 * tree


def test_matching_takes_in_edges_that_the_near_ones_miss(monkeypatch):
    """with two near nodes each, the least matching needs pairs that are found by their prices only."""
    monkeypatch.setattr(tsp, "NEAR", 2)
    rounds, extend = [], tsp._Blossoms.extend
    monkeypatch.setattr(tsp._Blossoms, "extend", lambda self, *a: rounds.append(1) or extend(self, *a))
    for seed in range(8):
        rng = np.random.default_rng(seed)
        d = rng.uniform(1, 9, (10, 10))
        d = d + d.T

        def least(left):
            return min((d[left[0], j] + least([x for x in left[1:] if x != j]) for j in left[1:]), default=0.0) if left else 0.0

        assert math.isclose(sum(d[p] for p in tsp.matching(d, list(range(10)))), least(list(range(10))))
    assert len(rounds) > 8


@pytest.mark.parametrize("kind", ["even", "clustered", "one place"])
def test_tours_that_grow_together_are_those_that_grow_alone(kind, monkeypatch):
    """the population of `genetic` grew tour by tour, each node against the whole tour."""
    monkeypatch.setattr(tsp, "TOGETHER", 500)
    rng = np.random.default_rng(19)
    xy = {"even": rng.uniform(0, 100, (900, 2)), "clustered": np.concatenate([rng.normal(0, 1, (600, 2)), rng.normal(50, 8, (300, 2))]), "one place": np.zeros((600, 2))}[kind]
    near = tsp.Lazy(xy, lambda x, y, u, v: np.sqrt((x - u) ** 2 + (y - v) ** 2))
    got = tsp.random_insertions(near, 5, [1, 2, 3])
    alone = [tsp.random_insertion(near, 5, seed) for seed in (1, 2, 3)]
    assert all(sorted(t) == list(range(len(xy))) and t[0] == 5 for t in got)
    assert got == alone if kind != "one place" else [tsp.cost(near, t) for t in got] == [0.0] * 3


@pytest.mark.parametrize("edges", ["Euclidean", "Manhattan"])
@pytest.mark.parametrize("n", [4, 5, 60, 150])
def test_annealing_by_places_equals_the_full_matrix(n, edges, monkeypatch):
    """the matrix was held; in arrays of moves or one by one, the moves are the same."""
    import pandas as pd

    pdf = pd.DataFrame(np.random.default_rng(n).uniform(0, 100, (n, 2)), columns=["x", "y"])
    d, near = routes.matrix(pdf, edges), routes.lazy(pdf, edges)
    tours = []
    for rare in (0.0, 0.1, 2.0):
        monkeypatch.setattr(tsp, "RARE", rare)
        tours += [tsp.simulated_annealing(c, list(range(n)), 3, cooling=0.8) for c in (d, near)]
    assert all(t == tours[0] for t in tours) and sorted(tours[0]) == list(range(n)) and tours[0][0] == 0
    assert all(type(v) is int for v in tours[0]) and (n < 60 or tsp.cost(d, tours[0]) < tsp.cost(d, list(range(n))))


def test_annealing_of_an_instance_holds_no_matrix(spark, monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(routes, "matrix", None)
    ran = []
    monkeypatch.setattr(routes, "_spread", lambda df, *more: SimpleNamespace(groupBy=lambda *k: SimpleNamespace(applyInPandas=lambda run, schema: ran.append(run))))
    pdf = pd.DataFrame({"instance_id": 1, "node_id": range(30), "x": np.arange(30.0) * 7 % 11, "y": np.arange(30.0) * 5 % 13})
    routes.solve_tsp(spark.createDataFrame(pdf), algo="Metaheuristic", meta="SA", cons="NearestNeighbor")
    assert sorted(ran[0](pdf)["seq"][0][:-1]) == list(range(30))
