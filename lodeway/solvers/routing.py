"""Small exact solvers: time windows, orienteering, several vehicles."""

from __future__ import annotations

import heapq
import math
from itertools import combinations

import numpy as np

from ..errors import OutOfRangeError
from . import tsp

SUBSET_LIMIT = 20
PARTITION_LIMIT = 12


def _check(n: int) -> None:
    if n > SUBSET_LIMIT:
        raise OutOfRangeError(f"exact search takes at most {SUBSET_LIMIT} nodes besides the depot")


def _table(d: np.ndarray, rest: list[int], depot: int, lo: np.ndarray, hi: np.ndarray, service: np.ndarray, leave: float, speed: float) -> np.ndarray:
    """Earliest departure from each last node of each subset of rest, infinite where its windows can't be kept.

    For one subset and last node an earlier departure is never worse, so one
    value for each is enough.  Subsets are met by size, all of one size at once.
    """
    m = len(rest)
    step = d[np.ix_(rest, rest)] / speed
    out = np.full((1 << m, m), np.inf)
    for j in range(m):
        at = max(leave + d[depot, rest[j]] / speed, lo[j])
        if at <= hi[j] + 1e-9:
            out[1 << j, j] = at + service[j]
    masks = np.arange(1 << m)
    size = np.bitwise_count(masks)
    for c in range(1, m):
        layer = masks[size == c]
        for j in range(m):
            held = layer[(layer >> j) & 1 == 0]
            at = np.maximum((out[held] + step[:, j]).min(axis=1), lo[j])
            fits = at <= hi[j] + 1e-9
            out[held[fits] | 1 << j, j] = at[fits] + service[j]
    return out


def _order(table: np.ndarray, step: np.ndarray, mask: int, last: int) -> list[int]:
    """Places in rest in the order of the best way through a subset to its last node."""
    out = [last]
    while mask := mask ^ 1 << last:
        last = int((table[mask] + step[:, last]).argmin())
        out.append(last)
    return out[::-1]


def _sums(values: np.ndarray) -> np.ndarray:
    """Sum of the values of each subset."""
    out = np.zeros(1)
    for v in values:
        out = np.concatenate((out, out + v))
    return out


def tsptw(d: np.ndarray, windows: np.ndarray, service: np.ndarray, depot: int = 0, start: float = 0.0, speed: float = 1.0) -> tuple[float, list[int]] | None:
    """Earliest return with every hard window kept: (time, order from the depot), or None."""
    rest = [i for i in range(len(d)) if i != depot]
    _check(len(rest))
    leave = max(start, windows[depot, 0]) + service[depot]
    if not rest:
        return (float(leave), [depot]) if leave <= windows[depot, 1] + 1e-9 else None
    table = _table(d, rest, depot, windows[rest, 0], windows[rest, 1], service[rest], leave, speed)
    back = table[-1] + d[rest, depot] / speed
    last = int(back.argmin())
    if not back[last] <= windows[depot, 1] + 1e-9:
        return None
    order = _order(table, d[np.ix_(rest, rest)] / speed, len(table) - 1, last)
    return float(back[last]), [depot, *(rest[i] for i in order)]


def _best_subset(gained: np.ndarray, total: np.ndarray, most: float) -> int:
    """Subset of the greatest gain whose total keeps the limit, the least total on ties."""
    fits = np.flatnonzero(total <= most + 1e-9)
    top = fits[gained[fits] >= gained[fits].max() - 1e-9]
    return int(top[total[top].argmin()])


def tsptw_violation(d: np.ndarray, windows: np.ndarray, service: np.ndarray, value: np.ndarray, depot: int = 0, start: float = 0.0, speed: float = 1.0) -> tuple[float, float, list[int]]:
    """Most visited value with windows kept, then earliest return: (value, time, order)."""
    rest = [i for i in range(len(d)) if i != depot]
    _check(len(rest))
    leave = max(start, windows[depot, 0]) + service[depot]
    if not rest:
        return 0.0, float(leave), [depot]
    table = _table(d, rest, depot, windows[rest, 0], windows[rest, 1], service[rest], leave, speed)
    ends = table + d[rest, depot] / speed
    back = ends.min(axis=1)
    back[0] = leave
    gained = _sums(value[rest])
    best = _best_subset(gained, back, max(windows[depot, 1], leave))
    order = _order(table, d[np.ix_(rest, rest)] / speed, best, int(ends[best].argmin())) if best else []
    return float(gained[best]), float(back[best]), [depot, *(rest[i] for i in order)]


def orienteering(d: np.ndarray, price: np.ndarray, budget: float, start: int, end: int) -> tuple[float, float, list[int]] | None:
    """Most collected price on a way from start to end within the budget: (price, length, way), or None."""
    rest = [i for i in range(len(d)) if i not in (start, end)]
    _check(len(rest))
    if d[start, end] > budget + 1e-9:
        return None
    base = price[start] + (price[end] if end != start else 0.0)
    if not rest:
        return float(base), float(d[start, end]), [start, end]
    none = np.zeros(len(rest))
    table = _table(d, rest, start, none, none + np.inf, none, 0.0, 1.0)
    ends = table + d[rest, end]
    total = ends.min(axis=1)
    total[0] = d[start, end]
    gained = base + _sums(price[rest])
    best = _best_subset(gained, total, budget)
    order = _order(table, d[np.ix_(rest, rest)], best, int(ends[best].argmin())) if best else []
    return float(gained[best]), float(total[best]), [start, *(rest[i] for i in order), end]


def _late(d: np.ndarray, route: list[int], windows: np.ndarray, service: np.ndarray, depot: int, speed: float) -> bool:
    """Whether a route from the depot and back misses a window."""
    t, at = windows[depot, 0] + service[depot], depot
    for j in route:
        t = max(t + d[at, j] / speed, windows[j, 0])
        if t > windows[j, 1] + 1e-9:
            return True
        t, at = t + service[j], j
    return t + d[at, depot] / speed > windows[depot, 1] + 1e-9


def vrptw_bounded(d: np.ndarray, demand: np.ndarray, windows: np.ndarray, service: np.ndarray, capacity: float, vehicles: int, depot: int = 0, speed: float = 1.0) -> tuple[float, list[list[int]], float] | None:
    """Routes of any number of customers by cheapest insertion and moves of one customer: (length, routes, lower bound), or None.

    The bound adds the least way in and out of each customer, halved.  Customers
    are met by the end of their windows, hardest first.
    """
    rest = sorted((i for i in range(len(d)) if i != depot), key=lambda i: (windows[i, 1], i))
    routes: list[list[int]] = []
    length = lambda r: sum(d[a, b] for a, b in zip([depot, *r], [*r, depot], strict=True))

    def places(j: int, skip: tuple[int, int] | None = None):
        for x, r in enumerate(routes):
            if sum(demand[i] for i in r) + demand[j] > capacity + 1e-9:
                continue
            for p in range(len(r) + 1):
                if (x, p) != skip:
                    a, b = r[p - 1] if p else depot, r[p] if p < len(r) else depot
                    yield d[a, j] + d[j, b] - d[a, b], x, p
        if len(routes) < vehicles:
            yield d[depot, j] + d[j, depot], len(routes), 0

    def put(j: int, below: float = np.inf) -> bool:
        for extra, x, p in sorted(places(j)):
            if extra >= below - 1e-9:
                return False
            new = [*routes[x][:p], j, *routes[x][p:]] if x < len(routes) else [j]
            if demand[j] <= capacity + 1e-9 and not _late(d, new, windows, service, depot, speed):
                routes[x : x + 1] = [new]
                return True
        return False

    if not all(put(j) for j in rest):
        return None
    moved = True
    while moved:
        moved = False
        for j in rest:
            x = next(x for x, r in enumerate(routes) if j in r)
            held = routes[x]
            less = [i for i in held if i != j]
            if _late(d, less, windows, service, depot, speed):
                continue
            saved = length(held) - length(less)
            routes[x : x + 1] = [less] if less else []
            if put(j, saved):
                moved = True
            elif less:
                routes[x] = held
            else:
                routes.insert(x, held)
    off = np.where(np.eye(len(d), dtype=bool), np.inf, d)
    lower = float((off[:, rest].min(axis=0) + off[rest].min(axis=1)).sum() / 2 + min(off[depot].min(), off[:, depot].min())) if rest else 0.0
    return float(sum(map(length, routes))), [[depot, *r] for r in routes], lower


def vrptw(d: np.ndarray, demand: np.ndarray, windows: np.ndarray, service: np.ndarray, capacity: float, vehicles: int, depot: int = 0, speed: float = 1.0) -> tuple[float, list[list[int]]] | None:
    """Least total length of at most `vehicles` routes from the depot: (length, routes), or None.

    Labels (customers, last, time, length) with dominance list every route worth
    having; a set partition over subsets then picks the best ones.
    """
    rest = [i for i in range(len(d)) if i != depot]
    m = len(rest)
    if m > PARTITION_LIMIT:
        raise OutOfRangeError(f"the exact partition takes at most {PARTITION_LIMIT} customers")
    leave0 = windows[depot, 0] + service[depot]
    best_route: dict[int, tuple[float, tuple]] = {}
    layer: dict[tuple[int, int], list[tuple[float, float, tuple]]] = {}
    for j in range(m):
        at = max(leave0 + d[depot, rest[j]] / speed, windows[rest[j], 0])
        if at <= windows[rest[j], 1] + 1e-9 and demand[rest[j]] <= capacity + 1e-9:
            layer[1 << j, j] = [(at + service[rest[j]], float(d[depot, rest[j]]), (rest[j],))]
    while layer:
        following: dict[tuple[int, int], list[tuple[float, float, tuple]]] = {}
        for (mask, i), labels in sorted(layer.items()):
            load = sum(demand[rest[x]] for x in range(m) if mask >> x & 1)
            for t, length, way in labels:
                if t + d[rest[i], depot] / speed <= windows[depot, 1] + 1e-9:
                    total = length + d[rest[i], depot]
                    if mask not in best_route or total < best_route[mask][0] - 1e-12:
                        best_route[mask] = (total, way)
                for j in range(m):
                    if mask >> j & 1 or load + demand[rest[j]] > capacity + 1e-9:
                        continue
                    at = max(t + d[rest[i], rest[j]] / speed, windows[rest[j], 0])
                    if at > windows[rest[j], 1] + 1e-9:
                        continue
                    new = (at + service[rest[j]], length + d[rest[i], rest[j]], (*way, rest[j]))
                    held = following.setdefault((mask | 1 << j, j), [])
                    if not any(a <= new[0] + 1e-12 and b <= new[1] + 1e-12 for a, b, _ in held):
                        held[:] = [x for x in held if not (new[0] <= x[0] and new[1] <= x[1])] + [new]
        layer = following
    full = (1 << m) - 1
    by_low: dict[int, list[int]] = {}
    for mask in best_route:
        by_low.setdefault(mask & -mask, []).append(mask)
    cost = {(0, 0): (0.0, ())}
    for done in range(full + 1):
        for used in range(vehicles):
            if (done, used) not in cost or done == full:
                continue
            c, chosen = cost[done, used]
            low = ~done & (done + 1)
            for mask in by_low.get(low, []):
                if not mask & done:
                    key, value = (done | mask, used + 1), c + best_route[mask][0]
                    if key not in cost or value < cost[key][0] - 1e-12:
                        cost[key] = (value, (*chosen, mask))
    ends = [cost[full, u] for u in range(vehicles + 1) if (full, u) in cost]
    if not ends:
        return None
    total, chosen = min(ends)
    return float(total), [[depot, *best_route[mask][1]] for mask in chosen]


def multi_tour(d: np.ndarray, xy: np.ndarray, vehicles: int, depot: int = 0, cons: str = "Insertion", improve: bool = True, seed: int = 0) -> list[list[int]]:
    """Tours of several vehicles with a small longest one.

    Sweep and Random split the nodes evenly and insert within each part;
    Insertion gives each node to the vehicle whose tour then stays shortest.
    """
    rest = [i for i in range(len(d)) if i != depot]
    part = lambda t: d.part(t) if isinstance(d, tsp.Lazy) else d[np.ix_(t, t)]
    if cons in ("Sweep", "Random"):
        order = tsp.sweep(xy, depot)[1:] if cons == "Sweep" else tsp.random_tour(d, depot, seed)[1:]
        parts = [list(p) for p in np.array_split(order, vehicles)]
        tours = []
        for p in parts:
            ids = [depot, *map(int, p)]
            tours.append([ids[i] for i in tsp.insertion(part(ids), 0)])
    else:
        order = rest if cons == "Insertion" else list(map(int, np.random.default_rng(seed).permutation(rest)))
        # tours and the lengths of the edges after their nodes grow in place
        tours, edges = np.full((vehicles, len(d)), depot), np.zeros((vehicles, len(d)))
        size, total = [1] * vehicles, [0.0] * vehicles
        for j in order:
            best = None
            for v, n in enumerate(size):
                to, back = d[tours[v, :n], j], d[j, tours[v, :n]]
                extra = to + np.append(back[1:], back[0]) - edges[v, :n]
                k = int(extra.argmin())
                grown = total[v] + extra[k]
                if best is None or grown < best[0] - 1e-12:
                    best = (grown, v, k, to[k], back[(k + 1) % n])
            _, v, k, to, back = best
            n = size[v] = size[v] + 1
            for row, value in ((tours[v], j), (edges[v], back)):
                row[k + 2 : n] = row[k + 1 : n - 1].copy()
                row[k + 1] = value
            edges[v, k] = to
            total[v] = float(edges[v, :n].sum())
        tours = [row[:n].tolist() for row, n in zip(tours, size, strict=True)]
    if improve:
        tours = [[t[i] for i in tsp.two_opt(part(t), list(range(len(t))))] for t in tours]
        tours = two_opt_star(d, tours)
    return tours


def two_opt_star(d: np.ndarray, tours: list[list[int]]) -> list[list[int]]:
    """Exchange the tails of two tours while the longer of the two becomes shorter."""
    better = True
    while better:
        better = False
        for x, y in combinations(range(len(tours)), 2):
            found = _shorter_tails(d, np.asarray(tours[x]), np.asarray(tours[y]))
            if found is not None:
                i, j = found
                tours[x], tours[y] = tours[x][:i] + tours[y][j:], tours[y][:j] + tours[x][i:]
                better = True
                break
    return tours


def _shorter_tails(d, a: np.ndarray, b: np.ndarray, cells: int = 1 << 16) -> tuple[int, int] | None:
    """The first (i, j) for which a[:i] + b[j:] and b[:j] + a[i:] are both shorter than the longer of a and b, by sums of heads and tails."""
    heads = [np.append(0.0, np.cumsum(d[t[:-1], t[1:]])) for t in (a, b)]
    worst = max(tsp.cost(d, a.tolist()), tsp.cost(d, b.tolist()))
    # ways from each node on to the end and back to the start of the other tour; of none behind the last, 0
    tails = [np.append(h[-1] - h[1:] + d[t[-1], o[0]], 0.0) for h, t, o in ((heads[0], a, b), (heads[1], b, a))]
    next_a, next_b = np.append(a[1:], b[0]), np.append(b[1:], a[0])
    rows = max(1, cells // len(b))
    for at in range(0, len(a), rows):
        i = slice(at, at + rows)
        p = heads[0][i, None] + d[a[i, None], next_b[None]] + tails[1][None]
        q = heads[1][None] + d[b[None], next_a[i, None]] + tails[0][i, None]
        good = np.flatnonzero(np.maximum(p, q) < worst - 1e-9)
        if len(good):
            return at + int(good[0]) // len(b) + 1, int(good[0]) % len(b) + 1
    return None


def dijkstra(graph: dict, start) -> dict:
    """Distances from start in {node: {node: weight}}."""
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        for to, w in graph.get(at, {}).items():
            if d + w < best.get(to, math.inf):
                best[to] = d + w
                heapq.heappush(heap, (d + w, to))
    return best
