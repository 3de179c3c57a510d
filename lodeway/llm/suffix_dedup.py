"""Exact byte-string dedup with a suffix array for each shard and merging by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import textnum as tn


def leading(data: np.ndarray, h: int = 8) -> np.ndarray:
    """The h bytes from each byte on as a number, zeros behind the end."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key <<= np.uint64(8)
        key |= wide[j : n + j]
    return key


def refine(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` bytes, and the group of each place in that order.

    Larsson-Sadakane: the rank of a suffix is the first place of its group, and
    each doubling sorts again only suffixes whose group has other members, by
    the rank of the suffix h bytes on.  The last step overlaps, to end at depth.
    """
    n = len(data)
    h = min(8, depth)
    key = leading(data, h)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    place = np.arange(n)
    fresh = np.append(True, key[1:] != key[:-1])
    group = np.maximum.accumulate(np.where(fresh, place, 0))
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    rank[sa] = group
    live = place[_shared(fresh)]
    while h < depth and len(live):
        step = min(h, depth - h)
        idx = sa[live]
        pair = (rank[idx].astype(np.uint64) << np.uint64(32)) | (rank[idx + step] + 1).astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        idx = idx[order]
        sa[live] = idx
        fresh = np.append(True, pair[1:] != pair[:-1])
        rank[idx] = np.maximum.accumulate(np.where(fresh, live, 0))
        live = live[_shared(fresh)]
        h += step
    return sa, rank[:n][sa]


def _shared(fresh: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, from the flags of group heads."""
    return ~(fresh & np.append(fresh[1:], True))


def common_prefixes(data: np.ndarray, sa: np.ndarray, group: np.ndarray, cap: int) -> np.ndarray:
    """Length that each suffix shares with its predecessor in its group, up to cap; 0 for heads of groups.

    Kasai: in text order the length falls by at most one from a suffix to the
    next, and by exactly one while the predecessors are neighbours too.  So only
    the heads of such runs are compared, eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = np.where(group[1:] == group[:-1], sa[:-1], -1)
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    at = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    reach = cap + np.diff(np.append(at, n))  # what the whole run can ask for
    wide = np.concatenate((data, np.zeros(16, np.uint8)))
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        i, j = at[live] + length[live], before[at[live]] + length[live]
        inside = (i < n) & (j < n) & (length[live] < reach[live])
        live, i, j = live[inside], i[inside], j[inside]
        same = wide[i] == wide[j]
        length[live[same]] += 1
        live = live[same]
    full = np.maximum(length[run] - (np.arange(n) - at[run]), 0)
    return np.minimum(full, cap)


class Shard:
    """The part of one key in a shard: its windows in suffix order and those that stand alone so far."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lone: np.ndarray, length: int, answer):
        self.starts, self.lone, self.answer = starts, lone, answer
        self.shift = np.uint64(8 * max(0, 8 - length))
        self.wide = leading(data) >> self.shift
        self.steps = [*range(0, length - 8, 8), max(0, length - 8)]

    def holds(self, other: Shard) -> np.ndarray:
        """Whether a window of this part equals each lone window of the other, by binary search in suffix order."""
        want = other.lone
        low, high = np.zeros(len(want), np.int64), np.full(len(want), len(self.starts))
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            less = self._order(self.starts[middle], other, want[live]) < 0
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
        out = np.zeros(len(want), bool)
        inside = np.flatnonzero(low < len(self.starts))
        out[inside] = self._order(self.starts[low[inside]], other, want[inside]) == 0
        return out

    def _order(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the windows of this part stand before, equal or follow those of the other."""
        sign, live = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for step in self.steps:
            x, y = self.wide[mine[live] + step], other.wide[theirs[live] + step]
            apart = x != y
            sign[live[apart]] = np.where(x[apart] < y[apart], -1, 1)
            live = live[~apart]
            if not len(live):
                break
        return sign

    def merge(self, other: Shard) -> None:
        mine, theirs = other.holds(self), self.holds(other)
        self.lone, other.lone = self.lone[~mine], other.lone[~theirs]


def sort_shard(symbol: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of a shard in suffix order, and by byte whether the window from there stands alone in the shard."""
    sa, group = refine(symbol, length)
    lcp = common_prefixes(symbol, sa, group, length)  # by text position
    cluster = np.cumsum(lcp[sa] < length) - 1
    valid = (np.arange(len(symbol)) + length <= np.repeat(bounds[1:], np.diff(bounds)))[sa]  # a suffix that runs over its segment's end is no partner
    size = np.bincount(cluster[valid], minlength=cluster[-1] + 1 if len(cluster) else 0)
    alone = np.zeros(len(symbol), bool)
    alone[sa] = valid & (size[cluster] == 1)
    return sa[valid], alone


class SuffixArray:
    """Windows of a key's segments that stand nowhere else."""

    @staticmethod
    def whole(first):
        """Every string of a text with a copy stands elsewhere too."""
        return F.lit(True)

    @staticmethod
    def distinct(sent: DataFrame) -> DataFrame:
        """One row for each distinct segment; once: it stands at one place."""
        place = sent.groupBy("m", "seg").agg(F.min("k").alias("k"), F.min("s").alias("s"), F.max("k").alias("k2"), F.max("s").alias("s2"), F.min("once").alias("one"))
        return place.select("m", "seg", "k", "s", (F.col("one") & (F.col("k") == F.col("k2")) & (F.col("s") == F.col("s2"))).alias("once"))

    @staticmethod
    def emit(unit: repeats.Unit, limit: int | None = None):
        """Windows that stand alone, from rows sorted by key.

        Rows are dealt into shards of equal bytes, wherever keys end, and each
        shard gets its suffix array.  Windows of different keys differ, so what
        is left to merge are keys that go on over the end of a shard: a window
        alone in its shard is looked up in the other shards of its key.
        """

        def run(batches: Iterator[pa.RecordBatch]):
            held: list[Shard] = []
            key = None
            for t in repeats.blocks(batches, limit or repeats.SHARD_BYTES, at_keys=False):
                m, once = t.column("m").to_numpy(), t.column("once").to_numpy()
                group = np.cumsum(np.append(True, m[1:] != m[:-1])) - 1
                # keys whose every segment repeats as a whole have nothing that stays, unless they go on elsewhere
                single = np.zeros(group[-1] + 1, bool)
                single[group[once]] = True
                keep = np.flatnonzero(single[group] | (m == m[-1]) | (m == key))
                m, once, k, s = m[keep], once[keep], t.column("k").chunk(0).take(pa.array(keep)), t.column("s").to_numpy()[keep]
                data, off = tn.flat(t.column("seg"))
                size = np.diff(off)[keep]
                symbol, bounds = data[tn.ranges(off[:-1][keep], size)], np.append(0, np.cumsum(size))
                starts, alone = sort_shard(symbol, bounds, unit.length)
                alone &= np.repeat(once, size)

                def answer(at: np.ndarray, bounds=bounds, k=k, s=s) -> pa.RecordBatch:
                    row = np.searchsorted(bounds, at, side="right") - 1
                    return pa.RecordBatch.from_arrays([k.take(pa.array(row)), pa.array((s[row] + at - bounds[row]).astype(np.int32))], ["k", "p"])

                def part(a: int, b: int, symbol=symbol, starts=starts, alone=alone, answer=answer) -> Shard:
                    return Shard(symbol[a:b], starts[(starts >= a) & (starts < b)] - a, np.flatnonzero(alone[a:b]), unit.length, lambda at: answer(at + a))

                # bytes of the first key, if it is the open one, and of the last key
                head = int(bounds[np.searchsorted(m != key, True)]) if key is not None and m[0] == key else 0
                tail = int(bounds[len(m) - np.searchsorted((m != m[-1])[::-1], True)])
                if head:
                    more = part(0, head)
                    for shard in held:
                        shard.merge(more)
                    held.append(more)
                if head < len(symbol):
                    yield from (x.answer(x.lone) for x in held)
                    yield answer(np.flatnonzero(alone[head:tail]) + head)
                    held = [part(tail, len(symbol))]
                key = m[-1]
            yield from (x.answer(x.lone) for x in held)

        return run


def suffix_dedup(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", hot: int = 5_000) -> DataFrame:
    """Remove each byte of strings of `length` bytes that stand at two places or more.

    Texts are UTF-8 bytes, matches never cross documents, overlaps count and
    every copy goes, the first too.  Returns doc_id, n_bytes, n_removed, spans
    (start and end of each maximal removed run) and kept (binary).

    Corner cases: null counts as empty; texts under `length` bytes lose nothing;
    rows without an id are known by their text, and equal ones are copies of
    each other; rows with one id and the same text stand for one document; texts
    that share an id are documents of their own; other columns are ignored; an
    empty table gives an empty result.  A task that runs again must read its
    rows in the same order, as scans of files do.
    """
    unit = repeats.Unit(words=False, length=length, k=min(64, length), hot=hot)
    marked = repeats.marked(docs, doc_id, text, unit, SuffixArray())
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    return marked.mapInArrow(_keep(length), schema)


def _keep(length: int):
    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                data, off = tn.flat(piece.column("text"))
                gone = repeats.covered(piece, off, length)
                edge, first, end = repeats.spans(gone, off)
                removed = np.diff(np.append(0, np.cumsum(gone))[off])
                size = np.diff(off)
                kept = np.append(0, np.cumsum(size - removed)).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
                parts = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
                found = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(removed.astype(np.int64)), found, raw], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return emit
