"""Tours over a distance matrix: construction, improvement, metaheuristics and exact search.

A tour is a list of node positions that starts at the depot and does not repeat
it.  All kernels take a full matrix, so asymmetric instances work throughout.
"""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np

from ..errors import SolverNotAvailableError, UnsupportedInputError

Tour = list[int]


def cost(d: np.ndarray, tour: Tour) -> float:
    t = np.asarray(tour)
    return float(d[t, np.roll(t, -1)].sum())


class Lazy:
    """A matrix over places whose cells are computed where they are asked for; indexed like an array by [rows, columns].

    length(x1, y1, x2, y2) is symmetric and gives exactly the cells of the full matrix;
    one(z), where given, makes a quick function of two positions from places as complex numbers.
    """

    def __init__(self, xy: np.ndarray, length, one=None) -> None:
        self.x, self.y = np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1])
        self.length, self.one = length, one

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at):
        i, j = at
        return self.length(self.x[i], self.y[i], self.x[j], self.y[j])

    def single(self):
        """at(i, j) for single cells without the cost of an array each; the last bit may differ from the cell's."""
        if self.one is None:
            return lambda i, j: float(self[i, j])
        return self.one([complex(*p) for p in zip(self.x.tolist(), self.y.tolist(), strict=True)])

    def part(self, nodes) -> Lazy:
        return Lazy(np.stack([self.x[nodes], self.y[nodes]], axis=1), self.length, self.one)

    def _cells(self) -> None:
        """Nodes sorted by cells of about two, row by row; `start` gives the first node of each cell."""
        n = len(self)
        self.low = self.x.min(), self.y.min()
        span = max(self.x.max() - self.low[0], self.y.max() - self.low[1])
        self.width = span * math.sqrt(2 / n) or 1.0
        cx, cy = (((c - low) / self.width).astype(int) for c, low in zip((self.x, self.y), self.low, strict=True))
        self.shape = int(cx.max()) + 1, int(cy.max()) + 1
        cell = cy * self.shape[0] + cx
        self.nodes = np.argsort(cell, kind="stable")
        self.start = np.searchsorted(cell[self.nodes], np.arange(self.shape[0] * self.shape[1] + 1))

    def around(self, at: np.ndarray, radius: np.ndarray):
        """(q, node) in runs: at least all nodes nearer to node at[q] than radius[q]; a length is never less than a coordinate's difference."""
        if not hasattr(self, "nodes"):
            self._cells()
        bound = lambda c, low, top: np.clip(((c - low) / self.width), 0, top - 1).astype(int)
        more = radius + 1e-9 * (1 + radius)
        x0, x1 = (bound(self.x[at] + r, self.low[0], self.shape[0]) for r in (-more, more))
        y0, y1 = (bound(self.y[at] + r, self.low[1], self.shape[1]) for r in (-more, more))
        rows = np.where(radius > 0, y1 - y0 + 1, 0)
        q = np.repeat(np.arange(len(at)), rows)
        first = (y0[q] + np.arange(len(q)) - np.repeat(np.cumsum(rows) - rows, rows)) * self.shape[0]
        lo, hi = self.start[first + x0[q]], self.start[first + x1[q] + 1]
        many = np.cumsum(hi - lo)
        done = 0
        while done < len(q):
            base = many[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(many, base + (1 << 20), side="right")))
            n = (hi - lo)[done:end]
            own = np.repeat(np.arange(done, end), n)
            node = self.nodes[lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
            own = q[own]
            near = (np.abs(self.x[at[own]] - self.x[node]) <= more[own]) & (np.abs(self.y[at[own]] - self.y[node]) <= more[own])
            yield own[near], node[near]
            done = end


def _steps(d, depot: int, pick) -> Tour:
    """A tour that goes on to left[pick(lengths to left)] until no node is left."""
    tour, left = [depot], np.array([i for i in range(len(d)) if i != depot], int)
    while len(left):
        at = pick(d[tour[-1], left])
        tour.append(int(left[at]))
        left = np.delete(left, at)
    return tour


def nearest_neighbour(d: np.ndarray, depot: int = 0, k: int = 1) -> Tour:
    """Always to the k-th nearest of the open nodes (the last one where fewer are left); ties by position."""

    def pick(row: np.ndarray) -> int:
        n = min(k, len(row))
        if n == 1:
            return int(row.argmin())
        value = np.partition(row, n - 1)[n - 1]
        return int(np.flatnonzero(row == value)[n - 1 - int((row < value).sum())])

    return _steps(d, depot, pick)


def farthest_neighbour(d: np.ndarray, depot: int = 0) -> Tour:
    return _steps(d, depot, lambda row: int(row.argmax()))


def insertion(d: np.ndarray, depot: int = 0, order: list[int] | None = None) -> Tour:
    """Depot and its farthest node, then every other node where it costs least."""
    rest = [i for i in range(len(d)) if i != depot]
    if not rest:
        return [depot]
    first = rest[int(d[depot, np.array(rest)].argmax())]
    if isinstance(d, Lazy):
        return _insert_places(d, depot, first, order if order is not None else rest)
    # the tour and the length of the edge after each of its nodes grow in place
    t, edge, n = np.empty(len(d), int), np.empty(len(d)), 2
    t[:2], edge[:2] = (depot, first), (d[depot, first], d[first, depot])
    for j in order if order is not None else rest:
        if j in (depot, first):
            continue
        to, back = d[t[:n], j], d[j, t[:n]]
        extra = np.append(to[:-1] + back[1:], to[-1] + back[0]) - edge[:n]
        k = int(extra.argmin())
        t[k + 2 : n + 1], edge[k + 2 : n + 1] = t[k + 1 : n].copy(), edge[k + 1 : n].copy()
        t[k + 1], edge[k], edge[k + 1] = j, to[k], back[(k + 1) % n]
        n += 1
    return t.tolist()


def _insert_places(d: Lazy, depot: int, first: int, order: list[int]) -> Tour:
    """`insertion` of the nodes of `order` with the places of the tour's nodes kept in its order."""
    size, n = len(d), 2
    t, edge, x, y = np.empty(size, int), np.empty(size), np.empty(size), np.empty(size)
    t[:2], x[:2], y[:2] = (depot, first), d.x[[depot, first]], d.y[[depot, first]]
    edge[:2] = d[depot, first]
    for j in order:
        if j in (depot, first):
            continue
        to = d.length(x[:n], y[:n], d.x[j], d.y[j])
        extra = to[:-1] + to[1:]
        extra -= edge[: n - 1]
        k = int(extra.argmin())
        if to[-1] + to[0] - edge[n - 1] < extra[k]:
            k = n - 1
        for c, value in ((t, j), (edge, to[(k + 1) % n]), (x, d.x[j]), (y, d.y[j])):
            c[k + 2 : n + 1] = c[k + 1 : n]
            c[k + 1] = value
        edge[k] = to[k]
        n += 1
    return t[:n].tolist()


#: Nodes from which many insertions into one set of places go on together, and steps of theirs between two searches.
TOGETHER, STEPS = 8000, 64


def random_insertions(d: np.ndarray | Lazy, depot: int, seeds: list[int]) -> list[Tour]:
    """`random_insertion` by each seed; of many places all tours grow together, which differs where insertions cost the same only."""
    if not isinstance(d, Lazy) or len(d) < TOGETHER:
        return [random_insertion(d, depot, seed) for seed in seeds]
    n, many = len(d), len(seeds)
    rest = np.delete(np.arange(n), depot)
    first = int(rest[int(d[depot, rest].argmax())])
    orders = np.stack([o[(o != depot) & (o != first)] for o in (np.random.default_rng(seed).permutation(n) for seed in seeds)])
    # short tours are searched as a whole
    begun = n // 8
    nxt, prv = np.full((many, n), -1), np.full((many, n), -1)
    edge = np.full((many, n), -np.inf)
    for lane in range(many):
        t = np.array(_insert_places(d, depot, first, orders[lane, :begun].tolist()))
        after = np.roll(t, -1)
        nxt[lane, t], prv[lane, after], edge[lane, t] = after, t, d[t, after]
    for at in range(begun, orders.shape[1], STEPS):
        _insert_together(d, orders[:, at : at + STEPS], nxt, prv, edge)
    tours = []
    for row in nxt.tolist():
        t = [depot]
        while (v := row[t[-1]]) != depot:
            t.append(v)
        tours.append(t)
    return tours


def _insert_together(d: Lazy, nodes: np.ndarray, nxt: np.ndarray, prv: np.ndarray, edge: np.ndarray) -> None:
    """Insert a row of nodes into the tour of each lane, one after the other, where each costs least.

    Edges there are at first are searched for all nodes at once, those that come
    up meanwhile at each step; a node whose edge has gone looks at the whole tour.
    """
    (many, steps), n, x, y = nodes.shape, len(d), d.x, d.y
    cost, place = _near_insertions(d, nodes, nxt, prv, edge)
    lanes = np.arange(many)
    # flat views, and where a lane begins in them
    fn, fp, fe, base = nxt.reshape(-1), prv.reshape(-1), edge.reshape(-1), lanes * n
    # the edges that have come up, by step: their starts, lengths and the places of both ends
    start, length = np.zeros((2 * steps, many), int), np.full((2 * steps, many), -np.inf)
    ends = np.zeros((4, 2 * steps, many))
    fs, fl, fends = start.reshape(-1), length.reshape(-1), ends.reshape(4, -1)
    slot = np.full(many * n, -1)
    for i in range(steps):
        j, best, k = nodes[:, i], cost[:, i], place[:, i]
        for lane in np.flatnonzero((k < 0) | (slot[base + k] >= 0)):
            to = d.length(x, y, x[j[lane]], y[j[lane]])
            extra = to + to[nxt[lane]] - edge[lane]
            k[lane] = extra.argmin()
            best[lane] = extra[k[lane]]
        jx, jy = x[j], y[j]
        if i:
            ax, ay, bx, by = ends[:, : 2 * i]
            extra = d.length(ax, ay, jx, jy)
            extra += d.length(bx, by, jx, jy)
            extra -= length[: 2 * i]
            new = extra.argmin(axis=0)
            k = np.where(extra[new, lanes] < best, start[new, lanes], k)
        atk, atj = base + k, base + j
        after = fn[atk]
        kx, ky, nx, ny = x[k], y[k], x[after], y[after]
        to, on = d.length(kx, ky, jx, jy), d.length(jx, jy, nx, ny)
        fn[atk], fn[atj], fp[atj], fp[base + after], fe[atk], fe[atj] = j, after, k, j, to, on
        # an edge that starts where another one did takes its slot, else the next one
        at = slot[atk]
        at = np.where(at < 0, 2 * i, at)
        slot[atk], slot[atj] = at, 2 * i + 1
        at = at * many + lanes
        fs[at], fl[at] = k, to
        fends[0, at], fends[1, at], fends[2, at], fends[3, at] = kx, ky, jx, jy
        start[2 * i + 1], length[2 * i + 1] = j, on
        ends[:, 2 * i + 1] = jx, jy, nx, ny


def _near_insertions(d: Lazy, nodes: np.ndarray, nxt: np.ndarray, prv: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, start of the edge) of the cheapest insertion of each node in the tour of its lane; start -1: not found near it.

    An edge of length e that costs c has an end within (c + e) / 2.  So edges of
    up to three mean lengths are sought among near nodes, the longer ones apart;
    what costs more than the search could overlook is not certain.
    """
    many, steps = nodes.shape
    at = nodes.ravel()
    best, place = np.full(len(at), np.inf), np.full(len(at), -1)
    mean = np.maximum(edge, 0).sum(axis=1) / np.count_nonzero(edge[0] > -np.inf)
    most = 3 * mean
    for lane in range(many):
        long = np.flatnonzero(edge[lane] > most[lane])
        if len(long):
            j, end = nodes[lane][:, None], nxt[lane, long]
            extra = d[j, long[None]] + d[j, end[None]] - edge[lane, long]
            own = slice(lane * steps, (lane + 1) * steps)
            k = extra.argmin(axis=1)
            best[own], place[own] = extra[np.arange(steps), k], long[k]
    sure = np.repeat(2 * mean, steps)
    for q, c in d.around(at, np.repeat((2 * mean + most) / 2, steps)):
        lane = q // steps
        inside = edge[lane, c] > -np.inf
        q, c, lane = q[inside], c[inside], lane[inside]
        j, to = at[q], d[at[q], c]
        for k, other in ((c, nxt[lane, c]), (prv[lane, c], prv[lane, c])):
            extra = to + d[j, other] - edge[lane, k]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            if not len(first):
                continue
            low = np.minimum.reduceat(extra, first)
            hit = np.flatnonzero(extra == np.repeat(low, np.diff(first, append=len(q))))
            hit = hit[np.unique(q[hit], return_index=True)[1]]
            better = hit[extra[hit] < best[q[hit]]]
            best[q[better]], place[q[better]] = extra[better], k[better]
    place[best > sure] = -1
    return best.reshape(many, steps), place.reshape(many, steps)


def random_insertion(d: np.ndarray, depot: int = 0, seed: int = 0) -> Tour:
    return insertion(d, depot, [int(i) for i in np.random.default_rng(seed).permutation(len(d))])


def random_tour(d: np.ndarray, depot: int = 0, seed: int = 0) -> Tour:
    rest = [i for i in range(len(d)) if i != depot]
    return [depot, *(int(i) for i in np.random.default_rng(seed).permutation(rest))]


def sweep(xy: np.ndarray, depot: int = 0) -> Tour:
    """By bearing around the depot, clockwise from +y; ties by distance, then position."""
    rel = xy - xy[depot]
    # by math, as numpy's own arctan2 depends on the machine in its last bit, which orders nodes in one direction
    deg = np.array([math.degrees(math.atan2(x, y)) for x, y in rel.tolist()]) % 360
    dist = np.hypot(rel[:, 0], rel[:, 1])
    order = np.lexsort((dist, deg, dist == 0))
    return [depot, *order[order != depot].tolist()]


def christofides(d: np.ndarray | Lazy, depot: int = 0) -> Tour:
    """Minimum spanning tree, minimum-weight perfect matching of its odd nodes, Euler tour, short cuts."""
    n = len(d)
    if n < 3:
        return [depot, *(i for i in range(n) if i != depot)]
    adj: list[list[int]] = [[] for _ in range(n)]
    for a, b in _spanning_tree(d, depot):
        adj[a].append(b)
        adj[b].append(a)
    odd = [i for i in range(n) if len(adj[i]) % 2]
    for a, b in matching(d, odd):
        adj[a].append(b)
        adj[b].append(a)
    stack, walk = [depot], []
    left = [sorted(x, reverse=True) for x in adj]
    while stack:
        v = stack[-1]
        if left[v]:
            u = left[v].pop()
            left[u].remove(v)
            stack.append(u)
        else:
            walk.append(stack.pop())
    return list(dict.fromkeys(walk[::-1]))


def _spanning_tree(d: np.ndarray | Lazy, depot: int) -> list[tuple[int, int]]:
    """Edges (node, parent) of a least spanning tree by the shorter of both ways; a row of lengths at a time."""
    places = isinstance(d, Lazy)
    left = np.delete(np.arange(len(d)), depot)
    x, y = (d.x[left], d.y[left]) if places else (left, left)

    def row(j: int) -> np.ndarray:
        return d.length(d.x[j], d.y[j], x, y) if places else np.minimum(d[j, left], d[left, j])

    near, parent, edges = row(depot), np.full(len(left), depot), []
    while len(edges) < len(d) - 1:
        k = int(near.argmin())
        j = int(left[k])
        edges.append((j, int(parent[k])))
        near[k], parent[k] = np.inf, -1
        # nodes that are in the tree are taken out where they have become many
        if len(edges) % max(64, len(left) // 8) == 0:
            keep = parent >= 0
            left, near, parent, x, y = left[keep], near[keep], parent[keep], x[keep], y[keep]
        way = row(j)
        closer = np.flatnonzero((way < near) & (parent >= 0))
        near[closer], parent[closer] = way[closer], j
    return edges


#: Nearest nodes that a node's edges go to at first in a matching.
NEAR = 10


def matching(d: np.ndarray | Lazy, nodes: list[int]) -> list[tuple[int, int]]:
    """Perfect matching of least weight of an even set of nodes, by blossoms (primal-dual).

    It is sought among the edges to near nodes; then every pair that is shorter
    than the prices of its nodes allow joins these, and the search goes on, until
    there is none: then no pair of all could make it shorter.  Weights are rounded
    to 2^-43 of the greatest, so prices are exact integers; an infinite weight
    counts as more than all finite ones together.
    """
    n = len(nodes)
    if n == 0:
        return []
    graph = _Places(d.part(nodes)) if isinstance(d, Lazy) else _Weights(d, nodes)
    u, v = graph.near()
    keys = np.unique(np.minimum(u, v) * n + np.maximum(u, v))
    found = _Blossoms(n)
    while len(keys):
        u, v = keys // n, keys % n
        found.extend(u, v, graph.weight(u, v))
        found.solve()
        found.measure()
        keys = np.unique(np.concatenate(list(graph.violated(found))))
    return [(nodes[i], nodes[j]) for i, j in enumerate(found.mate) if i < j]


class _Places:
    """Pairs of places for a matching; weights are even integers."""

    def __init__(self, d: Lazy) -> None:
        self.d, self.n = d, len(d)
        top = float(d.length(d.x.min(), d.y.min(), d.x.max(), d.y.max()))
        self.scale = 2.0**43 / top if top else 1.0

    def weight(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return 2 * np.rint(self.d[u, v] * self.scale).astype(np.int64)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges to near nodes, and of each node to the next one along rows of cells, which hold a perfect matching."""
        self.d._cells()
        found = [np.zeros((2, 0), int)]
        for q, v in self.d.around(np.arange(self.n), np.full(self.n, 1.5 * self.d.width)):
            q, v = q[q != v], v[q != v]
            order = np.lexsort((self.d[q, v], q))
            q, v = q[order], v[order]
            found.append(np.stack([q, v])[:, np.arange(len(q)) - np.searchsorted(q, q) < NEAR])
        row = self.d.nodes
        return tuple(np.concatenate([*found, np.stack([row[:-1], row[1:]])], axis=1))

    def violated(self, found: _Blossoms):
        # a length under the sum of two prices is under twice the greater one
        for u, v in self.d.around(np.arange(self.n), found.price / self.scale):
            yield found.short(np.minimum(u, v), np.maximum(u, v), self.weight(u, v))


class _Weights:
    """The same for a matrix."""

    def __init__(self, d: np.ndarray, nodes: list[int]) -> None:
        part = d[np.ix_(nodes, nodes)].astype(float)
        self.n, c = len(nodes), np.minimum(part, part.T)
        np.fill_diagonal(c, 0.0)
        c[~np.isfinite(c)] = (self.n + 1) * max(1.0, float(c[np.isfinite(c)].max()))
        top = float(c.max())
        self.c = 2 * np.rint(c * (2.0**43 / top if top else 1.0)).astype(np.int64)

    def weight(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.c[u, v]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        n, k = self.n, min(NEAR + 1, self.n)
        v = np.argpartition(self.c, k - 1, axis=1)[:, :k].ravel()
        u = np.repeat(np.arange(n), k)
        return np.append(u[u != v], np.arange(n - 1)), np.append(v[u != v], np.arange(1, n))

    def violated(self, found: _Blossoms):
        for i in range(self.n):
            yield found.short(np.full(self.n, i), np.arange(self.n), self.c[i])


class _Blossoms:
    """Perfect matching of least weight (even integers) in a graph that has one, by alternating trees from one free node at a time.

    Ids under n are nodes, the others blossoms.  A tree grows by events in the
    order of the price change `now` at which they come; prices change only within
    the tree, and are written down where a label ends, so a search costs what is
    near its root.  A weight less the prices y of its ends plus the z of all
    blossoms that hold both is never under 0, and is 0 on matched edges.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        self.adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.y, self.mate = [], [-1] * n
        self.top, self.base, self.parent, self.z = list(range(n)), list(range(n)), [-1] * n, [0] * n
        #: Of tops: 0 none, 1 outer, 2 inner; the edge by which it was reached; `now` at that time.
        self.label, self.link, self.since = [0] * n, [None] * n, [0] * n
        self.childs, self.edges, self.leaves = [[] for _ in range(n)], [[] for _ in range(n)], [[i] for i in range(n)]
        self.unused: list[int] = []

    def extend(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """Take edges in; prices they do not allow come down, and what was matched or shrunk there is matched anew."""
        new = list(zip(u.tolist(), v.tolist(), w.tolist(), strict=True))
        for a, b, c in new:
            self.adj[a].append((b, c))
            self.adj[b].append((a, c))
        y = self.y = self.y or [min(c for _, c in x) // 2 for x in self.adj]
        for a, b, c in new:
            if c < y[a] + y[b]:
                self._flatten(self.top[a])
                self._part(a)
                y[a] = min(y[a], c - y[b])
        for a in range(self.n):
            if self.mate[a] < 0 and self.top[a] == a:
                y[a] += min(c - y[a] - y[b] for b, c in self.adj[a])
                b = next((b for b, c in self.adj[a] if c == y[a] + y[b] and self.mate[b] < 0 and self.top[b] == b), -1)
                if b >= 0:
                    self.mate[a], self.mate[b] = b, a

    def _part(self, a: int) -> None:
        if self.mate[a] >= 0:
            self.mate[self.mate[a]] = self.mate[a] = -1

    def _flatten(self, b: int) -> None:
        """Blossoms under a top go, and its nodes are free; each bears half of the z of what it was in, which keeps all edges allowed."""
        todo = [b] if b >= self.n else []
        while todo:
            b = todo.pop()
            for v in self.leaves[b]:
                self.y[v] -= self.z[b] // 2
                self._part(v)
            todo += [c for c in self._open(b) if c >= self.n]

    def solve(self) -> None:
        """Free nodes search in turns, ever farther, so that they meet half-way and trees stay small."""
        limit = max(1, sum(map(abs, self.y)) // (8 * self.n))
        while free := [v for v in range(self.n) if self.mate[v] < 0]:
            for v in free:
                if self.mate[v] < 0:
                    self._search(v, limit)
            limit *= 2

    def measure(self) -> None:
        """Arrays for `short`: prices, and of each id the blossom above it, how many are above, and the sum of its z and theirs."""
        self.price, self.up = np.array(self.y), np.array(self.parent)
        self.deep, self.sum = np.zeros(len(self.up), int), np.zeros(len(self.up), np.int64)
        todo = [b for b in range(self.n, len(self.base)) if self.childs[b] and self.parent[b] < 0]
        while todo:
            b = todo.pop()
            self.sum[b] += self.z[b]
            for c in self.childs[b]:
                self.deep[c], self.sum[c] = self.deep[b] + 1, self.sum[b]
            todo += [c for c in self.childs[b] if c >= self.n]

    def short(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Keys u * n + v, u < v, of those pairs whose weight is under what prices and blossoms allow."""
        gap = w - self.price[u] - self.price[v]
        at = np.flatnonzero((u < v) & (gap < 0))
        u, v, gap = u[at], v[at], gap[at]
        keys, a, b, out = u * self.n + v, u, v, []
        while len(keys):
            # the deeper one goes up, until both are in one blossom or one of them is a top
            down = self.deep[a] >= self.deep[b]
            a, b = np.where(down, self.up[a], a), np.where(down, b, self.up[b])
            apart = (a < 0) | (b < 0)
            out.append(keys[apart])
            same = (a == b) & ~apart
            out.append(keys[same][gap[same] + self.sum[a[same]] < 0])
            on = ~(apart | same)
            keys, a, b, gap = keys[on], a[on], b[on], gap[on]
        return np.unique(np.concatenate([*out, np.zeros(0, np.int64)]))

    def _search(self, root: int, limit: int) -> None:
        top, label, since, y = self.top, self.label, self.since, self.y
        self.now, self.heap, self.tree = 0, [], []
        self._outer(top[root], None)
        while True:
            at, u, v, w = heapq.heappop(self.heap)
            if at > limit:
                self.now = limit
                break
            if v < 0:
                if label[u] == 2 and self.parent[u] < 0 and at == since[u] + self.z[u] // 2:
                    self.now = at
                    self._expand(u)
                continue
            a, b = top[u], top[v]
            if a == b or label[a] != 1 or label[b] == 2:
                continue
            # events from before a label changed are out of date
            if w != y[u] + at - since[a] + y[v] + (at - since[b] if label[b] else 0):
                continue
            self.now = at
            if label[b]:
                self._shrink(u, v)
            elif self.mate[self.base[b]] < 0:
                self._augment(u, v)
                break
            else:
                self._inner(b, (u, v))
        for b in self.tree:
            if label[b] and self.parent[b] < 0:
                was = label[b]
                self._settle(b)
                label[b] = 0
                if was == 1 and b >= self.n and self.z[b] == 0:
                    self._dissolve(b)

    def _settle(self, b: int) -> None:
        """Write down the prices under a top as they are now."""
        more = self.now - self.since[b] if self.label[b] == 1 else self.since[b] - self.now
        if more:
            for v in self.leaves[b]:
                self.y[v] += more
            if b >= self.n:
                self.z[b] += 2 * more
        self.since[b] = self.now

    def _outer(self, b: int, link: tuple[int, int] | None) -> None:
        self.label[b], self.link[b], self.since[b] = 1, link, self.now
        self.tree.append(b)
        self._scan(self.leaves[b], b)

    def _scan(self, nodes: list[int], a: int) -> None:
        now, top, label, since, y, heap, push = self.now, self.top, self.label, self.since, self.y, self.heap, heapq.heappush
        for u in nodes:
            own = y[u] + now - since[a]
            for v, w in self.adj[u]:
                b = top[v]
                if b != a and label[b] != 2:
                    gap = w - own - y[v]
                    push(heap, (now + gap if not label[b] else now + (gap - now + since[b]) // 2, u, v, w))

    def _inner(self, b: int, link: tuple[int, int], on: bool = True) -> None:
        self.label[b], self.link[b], self.since[b] = 2, link, self.now
        self.tree.append(b)
        if b >= self.n:
            heapq.heappush(self.heap, (self.now + self.z[b] // 2, b, -1, 0))
        if on:
            mate = self.mate[self.base[b]]
            self._outer(self.top[mate], (self.base[b], mate))

    def _above(self, a: int) -> int:
        """Next outer top on the way to the root."""
        link = self.link[a]
        return -1 if link is None else self.top[self.link[self.top[link[0]]][0]]

    def _shrink(self, u: int, v: int) -> None:
        a, b, seen = self.top[u], self.top[v], set()
        while a not in seen:
            if a >= 0:
                seen.add(a)
                a = self._above(a)
            if b >= 0:
                a, b = b, a
        root, childs, edges = a, [], [(u, v)]
        x = self.top[u]
        while x != root:
            childs.append(x)
            edges.append(self.link[x])
            x = self.top[self.link[x][0]]
        childs.append(root)
        childs.reverse()
        edges.reverse()
        x = self.top[v]
        while x != root:
            childs.append(x)
            edges.append(self.link[x][::-1])
            x = self.top[self.link[x][0]]
        if self.unused:
            new = self.unused.pop()
        else:
            new = len(self.base)
            for c in (self.base, self.parent, self.z, self.label, self.link, self.since, self.childs, self.edges, self.leaves):
                c.append(None)
        self.base[new], self.parent[new], self.z[new], self.label[new], self.link[new], self.since[new] = self.base[root], -1, 0, 1, self.link[root], self.now
        self.childs[new], self.edges[new] = childs, edges
        self.leaves[new] = [i for c in childs for i in self.leaves[c]]
        self.tree.append(new)
        fresh = []
        for c in childs:
            self._settle(c)
            if self.label[c] == 2:
                fresh += self.leaves[c]
            self.label[c], self.parent[c] = 0, new
        for i in self.leaves[new]:
            self.top[i] = new
        self._scan(fresh, new)

    def _open(self, b: int) -> list[int]:
        """The parts of a blossom become tops, the blossom goes."""
        childs = self.childs[b]
        for c in childs:
            self.parent[c], self.label[c] = -1, 0
            for i in self.leaves[c]:
                self.top[i] = c
        self.label[b], self.childs[b], self.leaves[b] = 0, [], []
        self.unused.append(b)
        return childs

    def _dissolve(self, b: int) -> None:
        todo = [b]
        while todo:
            todo += [c for c in self._open(todo.pop()) if c >= self.n and self.z[c] == 0]

    def _expand(self, b: int) -> None:
        """An inner blossom has come to 0: its parts on the even way from its entry to its base stay in the tree."""
        self._settle(b)
        (v, w), edges = self.link[b], self.edges[b]
        childs = self._open(b)
        j, step = childs.index(self.top[w]), -1
        if j % 2:
            j, step = j - len(childs), 1
        while j:
            self._inner(self.top[w], (v, w))
            j += step
            v, w = edges[j] if step == 1 else edges[j - 1][::-1]
            j += step
        self._inner(childs[0], (v, w), False)
        now, y = self.now, self.y
        for c in childs:
            if not self.label[c]:
                for v in self.leaves[c]:
                    for u, w in self.adj[v]:
                        a = self.top[u]
                        if self.label[a] == 1:
                            heapq.heappush(self.heap, (now + w - y[v] - y[u] - now + self.since[a], u, v, w))

    def _augment(self, u: int, v: int) -> None:
        """Match u to v, a node of a free top, and change the matching on the way from u to the root."""
        self._turn(self.top[v], v)
        self.mate[v] = u
        while True:
            a = self.top[u]
            self._turn(a, u)
            self.mate[u] = v
            if self.link[a] is None:
                return
            inner = self.top[self.link[a][0]]
            u, v = self.link[inner]
            self._turn(inner, v)
            self.mate[v] = u

    def _turn(self, b: int, v: int) -> None:
        """Match the parts of a blossom so that v is left to be matched outside."""
        todo = [(b, v)]
        while todo:
            b, v = todo.pop()
            if b < self.n:
                continue
            t = v
            while self.parent[t] != b:
                t = self.parent[t]
            todo.append((t, v))
            childs, edges = self.childs[b], self.edges[b]
            at = j = childs.index(t)
            step = -1
            if j % 2:
                j, step = j - len(childs), 1
            while j:
                j += step
                w, x = edges[j] if step == 1 else edges[j - 1][::-1]
                todo.append((childs[j], w))
                j += step
                todo.append((childs[j], x))
                self.mate[w], self.mate[x] = x, w
            self.childs[b], self.edges[b], self.base[b] = childs[at:] + childs[:at], edges[at:] + edges[:at], v


def two_opt(d: np.ndarray, tour: Tour, rounds: int = 10_000) -> Tour:
    """Turn stretches round while that gains; exact for asymmetric matrices too.

    Each round weighs all pairs of edges and turns the best stretch, then the
    next best ones that have no node in common with those turned so far.
    """
    t = np.asarray(tour)
    n = len(t)
    if n < 4:
        return list(map(int, t))
    near = isinstance(d, Lazy)
    if not near:
        i, j = np.triu_indices(n, 2)
    even = near or bool((d == d.T).all())
    for _ in range(rounds):
        nxt = np.roll(t, -1)
        edge = d[t, nxt]
        # edges (i, i+1) and (j, j+1); positions i+1..j are turned round
        if near:
            i, j, gain = _near_turns(d, t, nxt, edge)
        else:
            gain = edge[i] + edge[j] - d[t[i], t[j]] - d[nxt[i], nxt[j]]
        if not even:
            ahead, back = np.append(0.0, np.cumsum(d[t[:-1], t[1:]])), np.append(0.0, np.cumsum(d[t[1:], t[:-1]]))
            gain += (ahead[j] - ahead[i + 1]) - (back[j] - back[i + 1])
        good = np.flatnonzero(gain > 1e-9)
        if not len(good):
            break
        free = np.ones(n + 1, bool)
        for m in good[np.argsort(-gain[good], kind="stable")]:
            a, b = int(i[m]), int(j[m]) + 1
            if free[a] and free[b] and free[a : b + 1].all():
                free[a : b + 1] = False
                t[a + 1 : b] = t[a + 1 : b][::-1].copy()
    return list(map(int, t))


def _near_turns(d: Lazy, t: np.ndarray, nxt: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, gain) of all pairs of edges that gain, in order.

    A turn gains only where one of its two new edges is shorter than an old one
    at the same node, so nodes within an edge's length of its ends are all there are.
    """
    n = len(t)
    at = np.empty(n, int)
    at[t] = np.arange(n)
    found = [np.zeros(0, int)]
    values = [np.zeros(0)]
    for ends, back in ((t, 0), (nxt, 1)):
        for p, node in d.around(ends, edge):
            q = (at[node] - back) % n
            i, j = np.minimum(p, q), np.maximum(p, q)
            gain = edge[i] + edge[j] - d[t[i], t[j]] - d[nxt[i], nxt[j]]
            good = (j > i + 1) & (gain > 1e-9)
            found.append((i * n + j)[good])
            values.append(gain[good])
    key, first = np.unique(np.concatenate(found), return_index=True)
    return key // n, key % n, np.concatenate(values)[first]


def _near_moves(d: Lazy, r: np.ndarray, nxt: np.ndarray, edge: np.ndarray, at: np.ndarray, size: int, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in at, k, gain): the best edge of each stretch that gains; one of its two new edges is shorter than what it saves or than the edge."""
    n = len(r)
    place = np.empty(n, int)
    place[r] = np.arange(n)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

    def weigh(x: np.ndarray, k: np.ndarray) -> None:
        first, last = r[at[x]], r[at[x] + size - 1]
        gain = saved[x] - (d[r[k], first] + d[last, nxt[k]] - edge[k])
        good = (gain > 1e-9) & ((k < at[x] - 1) | (k >= at[x] + size))
        found.append((x[good], k[good], gain[good]))

    for x, node in d.around(r[at], saved):
        weigh(x, place[node])
    for k, node in d.around(nxt, edge):
        x = place[node] - size
        inside = (x >= 0) & (x < len(at))
        weigh(x[inside], k[inside])
    x, k, gain = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((k, -gain, x))
    x, k, gain = x[order], k[order], gain[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh], k[fresh], gain[fresh]


def or_opt(d: np.ndarray, tour: Tour, longest: int = 3) -> Tour:
    """Move stretches of up to `longest` nodes, the depot not among them, to where they cost least, while that gains.

    Each round weighs all stretches against all edges and makes the best moves
    that touch different nodes.
    """
    t = list(tour)
    n = len(t)
    while n > 3:
        r = np.asarray(t)
        nxt = np.roll(r, -1)
        edge = d[r, nxt]
        moves = []
        for size in range(1, min(longest, n - 2) + 1):
            at = np.arange(1, n - size + 1)
            first, last, after = r[at], r[at + size - 1], r[(at + size) % n]
            saved = d[r[at - 1], first] + d[last, after] - d[r[at - 1], after]
            if isinstance(d, Lazy):
                x, y, value = _near_moves(d, r, nxt, edge, at, size, saved)
                moves += [(float(-v), size, int(x), int(y)) for v, x, y in zip(value, at[x], y, strict=True)]
                continue
            extra = d[r[None], first[:, None]] + d[last[:, None], nxt[None]] - edge[None]
            gain = saved[:, None] - extra
            k = np.arange(n)[None]
            gain[(k >= at[:, None] - 1) & (k < at[:, None] + size)] = 0
            best = gain.argmax(axis=1)
            value = gain[np.arange(len(at)), best]
            moves += [(float(-v), size, int(x), int(y)) for v, x, y in zip(value, at, best, strict=True) if v > 1e-9]
        if not moves:
            break
        touched: set[int] = set()
        for _, size, x, y in sorted(moves):
            part = [int(v) for v in r[x : x + size]]
            own = {int(r[x - 1]), *part, int(r[(x + size) % n]), int(r[y]), int(nxt[y])}
            if own & touched:
                continue
            touched |= own
            for v in part:
                t.remove(v)
            here = t.index(int(r[y])) + 1
            t[here:here] = part
    return t


#: Annealing weighs moves in arrays once fewer than this share of a heat's moves are made; an array goes on after the first move made.
RARE = 0.03


def simulated_annealing(d: np.ndarray | Lazy, tour: Tour, seed: int = 0, start: float = 50.0, end: float = 0.05, cooling: float = 0.95, moves: int | None = None, weights: tuple[float, float, float] = (1, 1, 3)) -> Tour:
    """Swap neighbours, exchange two nodes or turn a stretch round, by weight; the best tour seen is returned."""
    rng = np.random.default_rng(seed)
    n = len(tour)
    if n < 4:
        return list(tour)
    t = array("i", tour)
    view = np.frombuffer(t, np.intc)  # the same memory: single nodes are read quicker by t, stretches turned by view
    best = cost(d, view)
    # top is taken only when a move leads away from the best tour
    top, kept, heat, rate = t[:], True, start, 1.0
    share = np.cumsum(np.asarray(weights, float) / sum(weights))
    moves = moves or 6 * n
    near = isinstance(d, Lazy)
    even, at = (True, d.single()) if near else (bool((d == d.T).all()), d.item)

    def make(exchange: bool, i: int, j: int, more: float) -> None:
        nonlocal top, kept, now, best
        if more > 0 and not kept:
            top, kept = t[:], True
        if exchange:
            t[i], t[j] = t[j], t[i]
        else:
            view[i : j + 1] = view[i : j + 1][::-1]
        now += more
        if now < best - 1e-9:
            best, kept = now, False

    while heat > end:
        # moves of one heat are drawn together; `most` is what each may cost
        kinds = np.searchsorted(share[:-1], rng.random(moves), side="right")
        one, two = rng.integers(1, n, moves), rng.integers(1, n - 1, moves)
        two += two >= one
        i, j = np.minimum(one, two), np.maximum(one, two)
        i = np.where(kinds == 0, np.minimum(i, n - 2), i)
        j = np.where(kinds == 0, i + 1, j)
        most = -heat * np.log1p(-rng.random(moves))
        now, made = cost(d, view), 0
        # neighbours that change places are a short stretch turned round
        exchange = (kinds == 1) & (j > i + 1)
        if even and rate < RARE:
            k, size = 0, int(min(2 / max(rate, 1e-9), 2048))
            while k < moves:
                part = slice(k, k + size)
                more = _weigh(d, view, exchange[part], i[part], j[part])
                good = more <= most[part]
                first = int(good.argmax())
                if good[first]:
                    make(bool(exchange[k + first]), int(i[k + first]), int(j[k + first]), float(more[first]))
                    made += 1
                    k += first + 1
                else:
                    k += size
        else:
            for swap, i, j, most in zip(exchange.tolist(), i.tolist(), j.tolist(), most.tolist(), strict=True):
                p, a, b, q = t[i - 1], t[i], t[j], t[j + 1 - n]
                if swap:
                    after, before = t[i + 1], t[j - 1]
                    more = at(p, b) + at(b, after) + at(before, a) + at(a, q) - at(p, a) - at(a, after) - at(before, b) - at(b, q)
                else:
                    more = at(p, b) + at(a, q) - at(p, a) - at(b, q)
                    if not even:
                        part = view[i : j + 1]
                        more += float(d[part[1:], part[:-1]].sum() - d[part[:-1], part[1:]].sum())
                if more <= most:
                    make(swap, i, j, more)
                    made += 1
        rate = made / moves
        heat *= cooling
    return (top if kept else t).tolist()


def _weigh(d: np.ndarray | Lazy, t: np.ndarray, exchange: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What each exchange or turn would cost on the tour as it is, for symmetric lengths."""
    p, a, b, q = t[i - 1], t[i], t[j], t[j + 1 - len(t)]
    more = d[p, b] + d[a, q] - d[p, a] - d[b, q]
    if len(x := np.flatnonzero(exchange)):
        p, a, b, q, after, before = p[x], a[x], b[x], q[x], t[i[x] + 1], t[j[x] - 1]
        more[x] = d[p, b] + d[b, after] + d[before, a] + d[a, q] - d[p, a] - d[a, after] - d[before, b] - d[b, q]
    return more


def genetic(d: np.ndarray, depot: int = 0, seed: int = 0, population: int = 30, generations: int = 200, mutation: float = 0.3) -> Tour:
    """Order crossover, fitness by distance to the best, tournament survival."""
    rng = np.random.default_rng(seed)
    n = len(d)
    if n < 4:
        return insertion(d, depot)
    pool = random_insertions(d, depot, [int(rng.integers(1 << 31)) for _ in range(population)])
    value = np.array([cost(d, t) for t in pool])
    for _ in range(generations):
        fitness = 1 / (value - 0.8 * value.min() + 1e-12)
        a, b = rng.choice(population, 2, replace=False, p=fitness / fitness.sum())
        i, j = sorted(rng.choice(np.arange(1, n), 2, replace=False))
        core = pool[a][i : j + 1]
        held = {depot, *core}
        rest = [x for x in pool[b] if x not in held]
        child = [depot, *rest[: i - 1], *core, *rest[i - 1 :]]
        if rng.random() < mutation:
            p, q = sorted(rng.choice(np.arange(1, n), 2, replace=False))
            kind = rng.integers(3)
            if kind == 0:
                child[p], child[q] = child[q], child[p]
            elif kind == 1:
                child[p : q + 1] = child[p : q + 1][::-1]
            else:
                child.insert(int(p), child.pop(int(q)))
        x, y = rng.choice(population, 2, replace=False)
        worse = x if value[x] > value[y] else y
        if worse != int(value.argmin()) or cost(d, child) < value[worse]:
            pool[worse], value[worse] = child, cost(d, child)
    return two_opt(d, pool[int(value.argmin())])


def held_karp(d: np.ndarray, depot: int = 0) -> Tour:
    """Optimal tour by dynamic programming over subsets, one layer of the table at a time."""
    others = [i for i in range(len(d)) if i != depot]
    m = len(others)
    if m == 0:
        return [depot]
    w = d[np.ix_(others, others)]
    best = np.full((1 << m, m), np.inf)
    came = np.full((1 << m, m), -1, np.int8)
    best[1 << np.arange(m), np.arange(m)] = d[depot, others]
    masks = np.arange(1 << m)
    size = np.array([bin(x).count("1") for x in masks])
    for k in range(1, m):
        layer = masks[size == k]
        for j in range(m):
            open_ = layer[(layer >> j & 1) == 0]
            if not len(open_):
                continue
            value = best[open_] + w[:, j]
            pick = value.argmin(axis=1)
            to = open_ | 1 << j
            best[to, j], came[to, j] = value[np.arange(len(open_)), pick], pick
    full = (1 << m) - 1
    last = int((best[full] + d[others, depot]).argmin())
    tour, mask = [], full
    while last >= 0:
        tour.append(others[last])
        mask, last = mask ^ (1 << last), int(came[mask, last])
    return [depot, *tour[::-1]]


def ascent(w: np.ndarray, depot: int, upper: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Node prices and the lower bound they give: least spanning trees with two links to the depot, by subgradients."""
    n = len(w)
    rest = np.array([i for i in range(n) if i != depot])
    price, best, kept, pace, stale = np.zeros(n), -np.inf, np.zeros(n), 2.0, 0
    for _ in range(steps):
        v = w + price[:, None] + price[None]
        degree = np.zeros(n, int)
        near, link = v[rest[0], rest].copy(), np.zeros(len(rest), int)
        seen = np.zeros(len(rest), bool)
        seen[0], total = True, 0.0
        for _ in range(len(rest) - 1):
            j = int(np.where(seen, np.inf, near).argmin())
            total += near[j]
            degree[[rest[j], rest[link[j]]]] += 1
            seen[j] = True
            closer = v[rest[j], rest] < near
            near, link = np.where(closer, v[rest[j], rest], near), np.where(closer, j, link)
        two = rest[np.argsort(v[depot, rest], kind="stable")[:2]]
        total += v[depot, two].sum()
        degree[two] += 1
        degree[depot] = 2
        bound = total - 2 * price.sum()
        if bound > best + 1e-9:
            best, kept, stale = bound, price.copy(), 0
        else:
            stale += 1
        if stale == 15:
            pace, stale = pace / 2, 0
        off = degree - 2
        if not off.any() or upper - best <= 1e-9 or pace < 1e-4:
            break
        price = price + pace * (upper - bound) / (off @ off) * off
    return kept, float(best)


def branch_and_bound(d: np.ndarray, depot: int = 0, nodes: int = 200_000) -> tuple[Tour, float]:
    """Best tour found by depth-first search, and a lower bound of all tours, its own length where the search ended.

    The bound of a path is a spanning tree of the open nodes, with its links, under
    the node prices of `ascent`.  After so many nodes the search stops with the
    best tour so far and the bound of the whole.
    """
    n = len(d)
    best = or_opt(d, two_opt(d, insertion(d, depot)))
    limit = cost(d, best)
    if n < 4:
        return best, limit
    w = np.minimum(d, d.T)
    price, lower = ascent(w, depot, limit)
    # priced lengths: every tour gets longer by the same amount
    more = 2 * price.sum()
    d, w = d + price[:, None] + price[None], w + price[:, None] + price[None]
    limit += more
    count = 0

    def tree(left: list[int]) -> float:
        near = w[left[0], left].copy()
        seen = np.zeros(len(left), bool)
        seen[0] = True
        total = 0.0
        for _ in range(len(left) - 1):
            j = int(np.where(seen, np.inf, near).argmin())
            total += near[j]
            seen[j] = True
            near = np.minimum(near, w[left[j], left])
        return total

    def search(path: Tour, length: float, left: list[int]) -> None:
        nonlocal best, limit, count
        count += 1
        if count > nodes:
            return
        if not left:
            total = length + d[path[-1], depot]
            if total < limit - 1e-9:
                best, limit = list(path), total
            return
        if length + tree(left) + w[path[-1], left].min() + w[left, depot].min() >= limit - 1e-9:
            return
        for j in sorted(left, key=lambda j: (d[path[-1], j], j)):
            search([*path, j], length + d[path[-1], j], [x for x in left if x != j])

    search([depot], 0.0, [i for i in range(n) if i != depot])
    length = limit - more
    return best, length if count <= nodes else min(lower, length)


def exact(d: np.ndarray, depot: int = 0) -> tuple[Tour, float]:
    """Every integer formulation has this one optimum: subset tables up to 13 nodes, else branch and bound; with its lower bound."""
    if len(d) > 13:
        return branch_and_bound(d, depot)
    tour = held_karp(d, depot)
    return tour, cost(d, tour)


def construct(name: str, d: np.ndarray, xy: np.ndarray | None = None, depot: int = 0, seed: int = 0, k: int = 1, initial: Tour | None = None) -> Tour:
    table = {
        "Initial": lambda: list(initial or range(len(d))),
        "Insertion": lambda: insertion(d, depot),
        "RandomInsertion": lambda: random_insertion(d, depot, seed),
        "NearestNeighbor": lambda: nearest_neighbour(d, depot, k),
        "FarthestNeighbor": lambda: farthest_neighbour(d, depot),
        "Sweep": lambda: sweep(xy, depot),
        "Christofides": lambda: christofides(d, depot),
        "Random": lambda: random_tour(d, depot, seed),
    }
    if name == "CycleCover":
        raise SolverNotAvailableError("cycle cover is not available")
    if name not in table:
        raise UnsupportedInputError(f"construction must be one of {', '.join(table)}")
    return table[name]()


def population(d: np.ndarray, size: int, depot: int = 0, seed: int = 0) -> list[Tour]:
    return [random_insertion(d, depot, seed + i) for i in range(size)]


def solve(d: np.ndarray, xy: np.ndarray | None = None, depot: int = 0, algo: str = "Heuristic", cons: str = "Insertion", impv: str | None = "2Opt", meta: str | None = None, seed: int = 0, k: int = 1, initial: Tour | None = None) -> Tour:
    """Tour from the depot by the named method."""
    if algo == "Exact":
        return exact(d, depot)[0]
    if algo == "Heuristic":
        t = construct(cons, d, xy, depot, seed, k, initial)
        t = two_opt(d, t) if impv in ("2Opt", "2Opt+OrOpt") else t
        return or_opt(d, t) if impv == "2Opt+OrOpt" else t
    if algo == "Metaheuristic":
        if meta in (None, "SA", "SimulatedAnnealing"):
            return simulated_annealing(d, construct(cons, d, xy, depot, seed, k, initial), seed)
        if meta in ("GA", "GeneticAlgorithm"):
            return genetic(d, depot, seed)
        raise SolverNotAvailableError(f"metaheuristic {meta} is not available")
    raise UnsupportedInputError("algo must be Exact, Heuristic or Metaheuristic")
