"""Shortest ways that visit regions in a fixed order, and close-enough tours."""

from __future__ import annotations

import math

import numpy as np

from ..errors import MissingParameterError, SolverNotAvailableError, UnsupportedInputError

Point = tuple[float, float]


def touch_disks(start: np.ndarray, end: np.ndarray, centers: np.ndarray, radii: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """Shortest way start -> disk 1 -> ... -> disk n -> end: (length, points).

    The length is convex in the points and each disk is convex, so improving one
    point at a time, between its neighbours, goes down to the optimum.
    """
    way = [tuple(map(float, p)) for p in (start, *centers, end)]
    disks = [(*way[i], float(radii[i - 1])) for i in range(1, len(way) - 1)]
    last = math.inf
    for _ in range(rounds):
        for i, (cx, cy, r) in enumerate(disks, 1):
            way[i] = _between(*way[i - 1], *way[i + 1], cx, cy, r)
        total = _way(way)
        if last - total < tol:
            break
        last = total
    return _way(way), np.array(way)


def _way(points: list[tuple]) -> float:
    return sum(math.dist(p, q) for p, q in zip(points, points[1:], strict=False))


def between_disk(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: float) -> np.ndarray:
    """Point of a disk with the least sum of ways to a and b."""
    return np.array(_between(*map(float, (*a, *b, *c)), float(r)))


def _between(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, r: float) -> Point:
    """between_disk on plain numbers, as arrays of two are slow."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    u = 0.0 if size == 0 else min(1.0, max(0.0, ((cx - ax) * dx + (cy - ay) * dy) / size))
    fx, fy = ax + u * dx, ay + u * dy
    if math.hypot(fx - cx, fy - cy) <= r:
        return fx, fy
    # on the circle: the sum has one minimum on the arc that faces the segment
    base = math.atan2(fy - cy, fx - cx)
    lo, hi = base - math.pi / 2, base + math.pi / 2
    cos, sin, hypot = math.cos, math.sin, math.hypot

    def value(t: float) -> float:
        x, y = cx + r * cos(t), cy + r * sin(t)
        return hypot(x - ax, y - ay) + hypot(x - bx, y - by)

    g = (math.sqrt(5) - 1) / 2
    x, y = hi - g * (hi - lo), lo + g * (hi - lo)
    vx, vy = value(x), value(y)
    for _ in range(60):
        if vx <= vy:
            hi, y, vy = y, x, vx
            x = hi - g * (hi - lo)
            vx = value(x)
        else:
            lo, x, vx = x, y, vy
            y = lo + g * (hi - lo)
            vy = value(y)
    t = (lo + hi) / 2
    return cx + r * cos(t), cy + r * sin(t)


def touch_rings(start: Point, end: Point, rings: list[list[Point]], sides: int = 12, tol: float = 1e-6, rounds: int = 40) -> tuple[float, list[Point]]:
    """Shortest way that touches the boundary of each polygon in order.

    A layered shortest path over sampled boundary points; then each layer is
    sampled again, finer, around its chosen point until the gain is under tol.
    """
    spans = [_perimeter(r) for r in rings]
    chosen = None
    window = [1.0] * len(rings)
    last = math.inf
    for k in range(rounds):
        layers, marks = [], []
        for i, ring in enumerate(rings):
            n = sides * len(ring) if k == 0 else 2 * sides + 1
            at = np.linspace(0, 1, n, endpoint=False) if k == 0 else (chosen[i] + np.linspace(-window[i], window[i], n)) % 1.0
            if k == 0:
                at = np.unique(np.append(at, _corners(ring)))
            marks.append(at)
            layers.append(_along(ring, spans[i], at))
        total, picks = layered(np.array([start], float), layers, np.array([end], float))
        chosen = [float(marks[i][p]) for i, p in enumerate(picks)]
        points = [tuple(map(float, layers[i][p])) for i, p in enumerate(picks)]
        window = [1.5 / len(marks[i]) if k == 0 else window[i] / 4 for i in range(len(rings))]
        if k > 0 and last - total < tol and max(window, default=0) < 1e-7:
            break
        last = total
    return total, [start, *points, end]


def layered(start: np.ndarray, layers: list[np.ndarray], end: np.ndarray) -> tuple[float, list[int]]:
    """Shortest path through one point of each layer."""
    cost, back, before = np.zeros(1), [], start
    for layer in [*layers, end]:
        w = cost[:, None] + np.linalg.norm(before[:, None] - layer[None], axis=2)
        back.append(w.argmin(axis=0))
        cost, before = w.min(axis=0), layer
    at, picks = 0, []
    for b in back[::-1]:
        at = int(b[at])
        picks.append(at)
    return float(cost[0]), picks[::-1][1:]


def _perimeter(ring: list[Point]) -> np.ndarray:
    p = np.array([*ring, ring[0]], float)
    return np.append(0.0, np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1)))


def _corners(ring: list[Point]) -> np.ndarray:
    s = _perimeter(ring)
    return s[:-1] / s[-1]


def _along(ring: list[Point], span: np.ndarray, at: np.ndarray) -> np.ndarray:
    p = np.array([*ring, ring[0]], float)
    u = (at % 1.0) * span[-1]
    return np.stack([np.interp(u, span, p[:, 0]), np.interp(u, span, p[:, 1])], axis=1)


def touch_cones(start: np.ndarray, end: np.ndarray, cones: list[dict], slope: float, rounds: int = 400, tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """Shortest 3D way through upright cones (apex on the ground, radius slope * z, z up to max_height)."""
    way = [tuple(map(float, start)), *((*map(float, c["center"]), float(c["max_height"])) for c in cones), tuple(map(float, end))]
    hypot, dist = math.hypot, math.dist

    def project(x: float, y: float, z: float, cx: float, cy: float, top: float) -> tuple[float, float, float]:
        flat = hypot(x - cx, y - cy)
        h = min(max(z, 0.0), top)
        if flat <= slope * h:
            return x, y, h
        h = min(max((z + slope * flat) / (1 + slope * slope), 0.0), top)
        r = min(flat, slope * h)
        return cx + (x - cx) / flat * r, cy + (y - cy) / flat * r, h

    shapes = way[1:-1]
    last = math.inf
    for _ in range(rounds):
        for i, cone in enumerate(shapes, 1):
            a, b, p = way[i - 1], way[i + 1], way[i]
            step = max(1.0, dist(a, b))
            pa, pb = dist(p, a), dist(p, b)
            for _ in range(60):
                u, v = step / max(pa, 1e-12), step / max(pb, 1e-12)
                q = project(*(p[k] - (p[k] - a[k]) * u - (p[k] - b[k]) * v for k in (0, 1, 2)), *cone)
                qa, qb = dist(q, a), dist(q, b)
                if qa + qb < pa + pb - 1e-13:
                    p, pa, pb = q, qa, qb
                else:
                    step /= 2
            way[i] = p
        total = _way(way)
        if last - total < tol:
            break
        last = total
    return total, np.array(way)


def chase(start: np.ndarray, end: np.ndarray, targets: list[tuple[np.ndarray, np.ndarray]], speed: float) -> tuple[float, list[tuple[np.ndarray, float]]] | None:
    """Meet targets (place, velocity) in order at a fixed speed, each as early as can be, then go to end: (time, stops)."""
    t, at, out = 0.0, start.astype(float), [(start.astype(float), 0.0)]
    for loc, vec in targets:
        here = loc + vec * t
        rel = here - at
        a, b, c = float(vec @ vec - speed * speed), 2 * float(rel @ vec), float(rel @ rel)
        if c == 0:
            wait = 0.0
        elif abs(a) < 1e-12:
            wait = -c / b if b < 0 else math.inf
        else:
            disc = b * b - 4 * a * c
            roots = [r for s in (-1, 1) if disc >= 0 and (r := (-b + s * math.sqrt(disc)) / (2 * a)) >= 0]
            wait = min(roots, default=math.inf)
        if not math.isfinite(wait):
            return None
        t += wait
        at = loc + vec * t
        out.append((at, t))
    t += float(np.linalg.norm(end - at)) / speed
    return t, [*out, (end.astype(float), t)]


def _ways(s: np.ndarray, e: np.ndarray, centers: np.ndarray | None, radii: np.ndarray | None, rings: list | None):
    """touch(order, rounds, tol): shortest way through regions in an order, and gap(way, i): how far a way passes region i."""
    if rings is None:
        return lambda o, rounds=2000, tol=1e-9: touch_disks(s, e, centers[o], radii[o], rounds, tol) if o else (float(np.linalg.norm(e - s)), np.vstack([s, e])), lambda way, i: _gap(way, centers[i]) - radii[i]

    def touch(o: list[int], rounds: int = 40, tol: float = 1e-6) -> tuple[float, np.ndarray]:
        total, way = touch_rings(tuple(s), tuple(e), [rings[i] for i in o], rounds=rounds, tol=tol)
        return total, np.array(way)

    marks = [_along(r, _perimeter(r), np.unique(np.append(np.linspace(0, 1, 24, endpoint=False), _corners(r)))) for r in rings]
    return touch, lambda way, i: min(_gap(way, c) for c in marks[i])


def close_enough_exact(start: Point, end: Point, centers: np.ndarray | None, radii: np.ndarray | None, rings: list | None = None) -> tuple[float, list[int], np.ndarray]:
    """Best order of disks or rings by depth-first search; a bound is the way through those chosen so far.

    For rings the bound and the result are as exact as touch_rings.
    """
    s, e = np.asarray(start, float), np.asarray(end, float)
    n = len(centers if rings is None else rings)
    touch, gap = _ways(s, e, centers, radii, rings)
    best: tuple[float, tuple[int, ...], np.ndarray | None] = (math.inf, (), None)
    seed = _insert_order(n, touch)
    total, way = touch(seed)
    best = (total, tuple(seed), way)

    def search(order: list[int], left: list[int]) -> None:
        nonlocal best
        total, way = touch(order)
        if total >= best[0] - 1e-7:
            return
        if not left:
            best = (total, tuple(order), way)
            return
        j = max(left, key=lambda i: (gap(way, i), -i))
        for k in range(len(order) + 1):
            search([*order[:k], j, *order[k:]], [x for x in left if x != j])

    search([], list(range(n)))
    return best[0], list(best[1]), best[2]


def _gap(way: np.ndarray, c: np.ndarray) -> float:
    out = math.inf
    for a, b in zip(way, way[1:], strict=False):
        ab = b - a
        size = float(ab @ ab)
        u = 0.0 if size == 0 else min(1.0, max(0.0, float((c - a) @ ab) / size))
        out = min(out, float(np.linalg.norm(a + u * ab - c)))
    return out


def _insert_order(n: int, touch) -> list[int]:
    order: list[int] = []
    for j in range(n):
        options = [[*order[:k], j, *order[k:]] for k in range(len(order) + 1)]
        order = min(options, key=lambda o: touch(o, rounds=30)[0])
    return order


def close_enough_genetic(start: Point, end: Point, centers: np.ndarray | None, radii: np.ndarray | None, seed: int = 0, population: int = 10, generations: int = 25, rings: list | None = None) -> tuple[float, list[int], np.ndarray]:
    """Genetic search over orders; a child keeps a stretch of one parent and the order of the other."""
    rng = np.random.default_rng(seed)
    s, e, n = np.asarray(start, float), np.asarray(end, float), len(centers if rings is None else rings)
    touch, _ = _ways(s, e, centers, radii, rings)
    value = lambda o: touch(o, rounds=25, tol=1e-6)[0]
    pool = [_insert_order(n, touch), *([int(i) for i in rng.permutation(n)] for _ in range(population - 1))]
    score = [value(o) for o in pool]
    for _ in range(generations):
        a, b = rng.choice(population, 2, replace=False)
        i, j = sorted(rng.integers(0, n + 1, 2))
        core = pool[a][i:j]
        rest = [x for x in pool[b] if x not in set(core)]
        child = rest[:i] + core + rest[i:]
        if n > 1 and rng.random() < 0.5:
            p, q = sorted(rng.choice(n, 2, replace=False))
            child[p : q + 1] = child[p : q + 1][::-1]
        v = value(child)
        worst = int(np.argmax(score))
        if v < score[worst]:
            pool[worst], score[worst] = child, v
    order = pool[int(np.argmin(score))]
    total, way = touch(order)
    return total, order, way


def close_enough(start: Point, end: Point, centers: np.ndarray, radii: np.ndarray | None = None, rings: list | None = None, algo: str = "Metaheuristic", seed: int = 0) -> tuple[float, list[int], np.ndarray]:
    """Tour from start to end that comes close enough to every node: (length, order, points).

    Up to 6 rings are searched whole by either algorithm.
    """
    if rings is None and radii is None:
        raise MissingParameterError("give radii or rings")
    if algo not in ("Exact", "Metaheuristic"):
        raise UnsupportedInputError("algo must be Exact or Metaheuristic")
    if algo == "Exact" or (rings is not None and len(rings) <= 6):
        return close_enough_exact(start, end, centers, radii, rings)
    return close_enough_genetic(start, end, centers, radii, seed, rings=rings)


def covering(cover: np.ndarray, need: np.ndarray) -> np.ndarray | None:
    """x >= 0 of least sum with cover @ x >= need, for cover >= 0; None where impossible.

    Simplex on the dual (max need @ y, cover.T @ y <= 1), which starts feasible;
    the prices of its slacks are x.  Bland's rule keeps it from cycling.
    """
    m, n = cover.shape
    if ((cover.sum(axis=1) == 0) & (need > 1e-9)).any():
        return None
    t = np.hstack([cover.T, np.eye(n), np.ones((n, 1))]).astype(float)
    z = np.append(-need.astype(float), np.zeros(n + 1))
    while True:
        enter = np.flatnonzero(z[:-1] < -1e-9)
        if not len(enter):
            return np.maximum(z[m:-1], 0.0)
        j = int(enter[0])
        rows = np.flatnonzero(t[:, j] > 1e-12)
        if not len(rows):
            return None
        i = int(rows[(t[rows, -1] / t[rows, j]).argmin()])
        t[i] /= t[i, j]
        for r in range(n):
            if r != i and t[r, j]:
                t[r] -= t[r, j] * t[i]
        z -= z[j] * t[i]


def service_times(pieces: list[tuple[float, set[int]]], demand: dict[int, float], max_speed: float, mode: str = "AccuOverlap") -> list[float] | None:
    """Least times on the pieces (length, regions that cover it) so that every region gets its demand; None where it can't.

    AccuOverlap: time on a piece counts for every region that covers it (a
    covering program).  AccuNonOverlap: each instant counts for one region only,
    so the flow of the driving time to the demands says what is missing.
    """
    base = np.array([length / max_speed for length, _ in pieces], float)
    regions = sorted(demand)
    cover = np.array([[r in held for _, held in pieces] for r in regions], float).reshape(len(regions), len(pieces))
    need = np.array([demand[r] for r in regions], float)
    if mode == "AccuOverlap":
        extra = covering(cover, np.maximum(need - cover @ base, 0.0))
        return None if extra is None else list(base + extra)
    if mode != "AccuNonOverlap":
        raise SolverNotAvailableError(f"service mode {mode} is not available")
    if ((cover.sum(axis=1) == 0) & (need > 1e-9)).any():
        return None
    flow = np.zeros_like(cover)
    while True:  # augment along shortest ways region -> piece -> region ...
        spare, lack = base - flow.sum(axis=0), need - flow.sum(axis=1)
        came: dict[tuple[str, int], tuple[str, int] | None] = {("r", i): None for i in np.flatnonzero(lack > 1e-9).tolist()}
        queue, end = list(came), None
        while queue and end is None:
            kind, i = queue.pop(0)
            near = [("p", int(j)) for j in np.flatnonzero(cover[i])] if kind == "r" else [("r", int(j)) for j in np.flatnonzero(flow[:, i] > 1e-9)]
            for v in near:
                if v not in came:
                    came[v] = (kind, i)
                    if v[0] == "p" and spare[v[1]] > 1e-9:
                        end = v
                        break
                    queue.append(v)
        if end is None:
            break
        way = [end]
        while came[way[-1]] is not None:
            way.append(came[way[-1]])
        way = way[::-1]
        size = min([spare[end[1]], lack[way[0][1]], *(flow[way[k][1], way[k - 1][1]] for k in range(2, len(way), 2))])
        for a, b in zip(way, way[1:], strict=False):
            if a[0] == "r":
                flow[a[1], b[1]] += size
            else:
                flow[b[1], a[1]] -= size
    time = base.copy()
    for i in np.flatnonzero(lack > 1e-9):
        time[int(np.flatnonzero(cover[i])[0])] += lack[i]
    return list(time)
