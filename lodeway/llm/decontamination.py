"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .keys import NARROW, WIDE, repeats_ids, row_key

BITS = 64
WIDTHS = (13, 13, 13, 13, 12)  # of the blocks of a fingerprint
ITEMS_A_BLOCK = 32_768  # benchmark items broadcast at a time, about 1 KB each
PIECE = 1 << 16  # shingles whose votes are summed at a time
PROBES = 1 << 19  # block values looked up at a time


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tn.flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle hash."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def pack(votes: np.ndarray) -> np.ndarray:
    """Fingerprints from bit votes; ties give 0."""
    return np.packbits(votes > 0, axis=1, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()


@dataclass
class Index:
    """Fingerprints of a block of benchmark items, by length and by five bit blocks.

    Two fingerprints within `radius` bits differ by at most radius // 5 bits in
    one of the blocks.  Each item is filed once under its value of every block;
    a window looks up all values so near to its own, and so finds each
    fingerprint within the radius.
    """

    shingle: int
    radius: int
    ids: list  # by item number
    size: np.ndarray  # words of an item
    prints: np.ndarray
    bounds: np.ndarray  # of an item's shingles in `known` and `times`
    known: np.ndarray
    times: np.ndarray
    grams: dict  # words of a shingle -> sorted hashes and owners
    tables: dict  # shingle words and item words -> for each block sorted values and items

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], shingle: int, radius: int) -> Index:
        data, off = normalised(pa.array([t for _, t in rows], pa.large_string()))
        w = tn.Words(data, off, between=tn.NOT_ALNUM)
        some = np.flatnonzero(w.count)
        known, times, prints = [], [], []
        for i in some:
            n = int(w.count[i])
            gram, valid = tn.grams(w.hash[w.bounds[i] : w.bounds[i + 1]], np.array([0, n]), min(n, shingle))
            values, counts = np.unique(gram[valid], return_counts=True)
            known.append(values)
            times.append(counts.astype(np.int32))
            prints.append((signs(values).astype(np.int32) * counts[:, None].astype(np.int32)).sum(axis=0))
        size, width = w.count[some], np.minimum(w.count[some], shingle)
        prints = pack(np.stack(prints)) if len(some) else np.zeros(0, np.uint64)
        bounds = np.append(0, np.cumsum([len(x) for x in known])).astype(np.int64)
        out = cls(shingle, radius, [rows[i][0] for i in some], size, prints, bounds, np.concatenate(known or [np.zeros(0, np.uint64)]), np.concatenate(times or [np.zeros(0, np.int32)]), {}, {})
        owner = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(bounds))
        for k in np.unique(width).tolist():
            mine = width[owner] == k
            order = np.argsort(out.known[mine], kind="stable")
            out.grams[k] = (out.known[mine][order], owner[mine][order])
        for k, n in sorted(set(zip(width.tolist(), size.tolist(), strict=True))):
            group = np.flatnonzero((width == k) & (size == n)).astype(np.int32)
            out.tables[k, n] = []
            for value in out.blocks(prints[group]):
                order = np.argsort(value, kind="stable")
                out.tables[k, n].append((value[order].astype(np.uint16), group[order]))
        return out

    @staticmethod
    def blocks(prints: np.ndarray) -> list[np.ndarray]:
        shift = np.append(0, np.cumsum(WIDTHS)[:-1])
        return [((prints >> np.uint64(s)) & np.uint64((1 << width) - 1)).astype(np.int64) for s, width in zip(shift, WIDTHS, strict=True)]

    def near(self, key: tuple[int, int], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and distances of all pairs within the radius."""
        win, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, value, (values, owner) in zip(WIDTHS, self.blocks(prints), self.tables[key], strict=True):
            flips = _flips(width, self.radius // len(WIDTHS))
            step = max(1, PROBES // len(flips))
            for at in range(0, len(value), step):
                probe = (value[at : at + step, None] ^ flips).ravel()
                a, b = np.searchsorted(values, probe), np.searchsorted(values, probe, side="right")
                win.append(np.repeat(at + np.arange(len(probe)) // len(flips), b - a))
                item.append(owner[tn.ranges(a, b - a)].astype(np.int64))
        pairs = np.unique(np.stack((np.concatenate(win), np.concatenate(item))), axis=1)
        distance = np.bitwise_count(prints[pairs[0]] ^ self.prints[pairs[1]])
        keep = distance <= self.radius
        return pairs[0][keep], pairs[1][keep], distance[keep]

    def similarity(self, gram: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's, each weighing as often as it stands there."""
        known, times = (x[self.bounds[item] : self.bounds[item + 1]] for x in (self.known, self.times))
        values, counts = np.unique(gram, return_counts=True)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        both = int(np.minimum(counts, times[at])[known[at] == values].sum())
        return both / (len(gram) + int(times.sum()) - both)


@lru_cache(maxsize=None)
def _flips(width: int, most: int) -> np.ndarray:
    """Masks of at most so many bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], np.int64)


def fingerprints(gram: np.ndarray, starts: np.ndarray, q: int) -> np.ndarray:
    """SimHash of the q shingles from each start (in order); votes are summed for PIECE shingles at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + PIECE))
        votes = np.zeros((int(starts[j - 1]) + q - a + 1, BITS), np.int32)
        np.cumsum(signs(gram[a : starts[j - 1] + q]), axis=0, dtype=np.int32, out=votes[1:])
        here = starts[i:j] - a
        out[i:j] = pack(votes[here + q] - votes[here])
        i = j
    return out


def search(index: Index, words: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
    """Best window of one document for each item: item number, similarity, first word, words, distance.

    Only windows that hold a shingle of the benchmark, of the sizes of the items
    that own these shingles, can be similar at all; others are not fingerprinted.
    """
    best: dict[int, tuple] = {}
    n = len(words)
    for k, (known, owner) in index.grams.items():
        if n < k:
            continue
        gram, valid = tn.grams(words, np.array([0, n]), k)
        gram = gram[valid]
        a, b = np.searchsorted(known, gram), np.searchsorted(known, gram, side="right")
        hit = np.flatnonzero(b > a)
        if not len(hit):
            continue
        size = index.size[owner[tn.ranges(a[hit], (b - a)[hit])]]
        place = np.repeat(hit, (b - a)[hit])
        for m in np.unique(size).tolist():
            q = min(m - k + 1, len(gram))
            mine = np.unique(place[size == m])
            first = np.maximum(mine - q + 1, 0)
            starts = np.unique(tn.ranges(first, np.minimum(mine, len(gram) - q) - first + 1))
            win, item, distance = index.near((k, m), fingerprints(gram, starts, q))
            for w, i, d in zip(win.tolist(), item.tolist(), distance.tolist(), strict=True):
                s = int(starts[w])
                score = index.similarity(gram[s : s + q], i)
                if score >= least and (i not in best or (-score, s) < (-best[i][1], best[i][2])):
                    best[i] = (i, score, s, q + k - 1, int(d))
    return list(best.values())


def _scan(index, least: float):
    def emit(batches: Iterator[pa.RecordBatch]):
        idx = index.value
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                w = tn.Words(*normalised(piece.column("text")), between=tn.NOT_ALNUM)
                found = np.zeros(len(w.count), bool)
                for k, (known, _) in idx.grams.items():
                    gram, valid = w.grams(k)
                    at = np.flatnonzero(valid)
                    place = np.minimum(np.searchsorted(known, gram[at]), len(known) - 1)
                    hit = at[known[place] == gram[at]]
                    found[np.searchsorted(w.bounds, hit, side="right") - 1] = True
                out = [[] for _ in range(6)]
                for i in np.flatnonzero(found):
                    for item, score, start, size, d in search(idx, w.hash[w.bounds[i] : w.bounds[i + 1]], least):
                        for c, v in zip(out, (i, idx.ids[item], score, start, size, d), strict=True):
                            c.append(v)
                row = pa.array(out.pop(0), pa.int64())
                types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column("k").take(row), piece.column("doc_id").take(row), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["k", "doc_id", "item_id", "similarity", "first_word", "n_words", "distance"])

    return emit


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    held = []
    for row in benchmark.select(benchmark[item_id].cast("long"), benchmark[text].cast("string")).toLocalIterator():
        held.append(tuple(row))
        if len(held) == ITEMS_A_BLOCK:
            yield held
            held = []
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, shingle: int = 5, radius: int = 19, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", wide: bool = False) -> DataFrame:
    """Benchmark items that stand in documents, exactly or nearly.

    Words are runs of letters and digits, lower case.  A window has the size of
    the item (the whole document where that is shorter); candidates are windows
    whose SimHash lies within `radius` bits of the item's, and stay when the
    weighted Jaccard of `shingle`-word shingles is `least` or more.  Returns k,
    doc_id, item_id, similarity, first_word, n_words and distance of the best
    window of each document and item.

    The benchmark is the stated query set: it goes out in blocks of
    ITEMS_A_BLOCK items, each read against all documents.

    Corner cases: null and empty texts and items match nothing; items under
    `shingle` words have their whole sequence as one shingle; repeated rows are
    judged row by row; other columns are ignored; an empty table on either side
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(docs[doc_id], docs[text], wide).alias("k"), docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = f"k {WIDE if wide else NARROW}, doc_id long, item_id long, similarity double, first_word int, n_words int, distance int"
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        index = spark.sparkContext.broadcast(Index.build(block, shingle, radius))
        part = rows.mapInArrow(_scan(index, least), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns kept.

    Rows are known by id, and by id and text where one id has several texts, so
    a text that holds no item stays.
    """
    wide = repeats_ids(docs, options.get("doc_id", "doc_id"), options.get("text", "text"))
    key = row_key(docs[options.get("doc_id", "doc_id")], docs[options.get("text", "text")], wide)
    found = leaks(docs, benchmark, wide=wide, **options).select("k").distinct()
    return docs.select(key.alias("k"), F.struct("*").alias("row")).join(found, "k", "left_anti").select("row.*")
