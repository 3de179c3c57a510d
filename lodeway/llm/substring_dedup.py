"""Substring dedup by relative Lempel-Ziv parsing against reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import textnum as tn


def longest_earlier(symbol: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and source of the longest match of each place with text that starts earlier in the block; 0 under `least`.

    The index files the places of a block in chains of equal strings of `least`
    symbols.  A chain of two or more is split by the next symbol, again and
    again, while its members reach on in their segments; the first member of a
    chain is the source of the others.
    """
    n = len(symbol)
    reach, source = np.zeros(n, np.int64), np.full(n, -1)
    end = np.repeat(bounds[1:], np.diff(bounds))
    gram, valid = tn.grams(symbol, bounds, least)
    at, key, length = np.flatnonzero(valid), gram[valid], least
    while len(at):
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        head = np.append(True, key[1:] != key[:-1])
        chain = np.cumsum(head) - 1
        first = at[head][chain]
        late = ~head
        reach[at[late]], source[at[late]] = length, first[late]
        on = (np.bincount(chain)[chain] > 1) & (at + length < end[at])
        at, chain = at[on], chain[on]
        order = np.argsort(at, kind="stable")
        at, chain = at[order], chain[order]
        key = tn.mix(symbol[at + length] ^ tn.mix(chain.astype(np.uint64) + tn.U64(1)))
        length += 1
    return reach, source


def factors(symbol: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, source and length of the factors of a greedy parse of all segments of a block.

    Each segment is read from its start.  Where the index knows an earlier match
    of `least` symbols or more, the longest one becomes a factor, and the index
    is asked again at its border: at the first window that doesn't lie within
    the factor.  Elsewhere the parse moves on by one symbol.
    """
    n = len(symbol)
    reach, source = longest_earlier(symbol, bounds, least)
    known = np.where(np.append(reach > 0, True), np.arange(n + 1), n)
    ahead = np.minimum.accumulate(known[::-1])[::-1]  # the next place with a match
    at, last = bounds[:-1], bounds[1:] - least + 1
    found = [np.zeros(0, np.int64)]
    while True:
        live = at < last
        at, last = ahead[at[live]], last[live]
        live = at < last
        at, last = at[live], last[live]
        if not len(at):
            break
        found.append(at)
        at = at + reach[at] - least + 1
    at = np.sort(np.concatenate(found))
    return at, source[at], reach[at]


def parse(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of the windows of `least` words that no factor covers.

    Factors are found by word hashes and compared byte by byte with their
    sources; should one differ, the block is parsed again with exact numbers
    for its words.
    """
    w = tn.Words(data, off)
    at, source, length = factors(w.hash, w.bounds, least)
    if not alike(data, w, at, source, length).all():
        names: dict[bytes, int] = {}
        raw = data.tobytes()
        exact = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.uint64)
        at, source, length = factors(tn.mix(exact + tn.U64(1)), w.bounds, least)
        sound = alike(data, w, at, source, length)
        at, length = at[sound], length[sound]
    n = len(w.hash)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length - least + 1, -1)
    stays = np.cumsum(edge[:-1]) == 0
    stays &= np.arange(n) + least <= np.repeat(w.bounds[1:], w.count)
    here = np.flatnonzero(stays)
    row = np.repeat(np.arange(len(w.count)), w.count)[here]
    return row, here - w.bounds[row]


def alike(data: np.ndarray, w: tn.Words, at: np.ndarray, source: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words of each factor are those of its source, byte by byte (one space between words)."""
    if not len(at):
        return np.ones(0, bool)
    a, b = w.start[at], w.start[source]
    size = w.end[at + length - 1] - a
    same = size == w.end[source + length - 1] - b
    equal = data[tn.ranges(a[same], size[same])] == data[tn.ranges(b[same], size[same])]
    out = same.copy()
    if same.any():
        out[same] = np.logical_and.reduceat(equal, np.append(0, np.cumsum(size[same])[:-1]))
    return out


class Parse:
    """Factor the segments of a reference block against what stands earlier in it."""

    @staticmethod
    def whole(first):
        """A copy stands earlier in the first of its group; the first itself need not."""
        return ~first

    @staticmethod
    def distinct(sent: DataFrame) -> DataFrame:
        """One row for each distinct segment, at its earliest place."""
        first = sent.groupBy("m", "seg").agg(F.min(F.struct("k", "s")).alias("first"))
        return first.select("m", "seg", "first.k", "first.s", F.lit(True).alias("once"))

    @staticmethod
    def emit(unit: repeats.Unit):
        """Windows that stay, from rows sorted by key; a block holds whole keys, its segments by document and start."""

        def run(batches: Iterator[pa.RecordBatch]):
            for t in repeats.blocks(batches, repeats.SHARD_BYTES, at_keys=True):
                k, s = t.column("k").chunk(0), t.column("s").to_numpy()
                order = np.lexsort([s, *repeats.sort_keys(k)])
                data, off = tn.flat(t.column("seg"))
                size = np.diff(off)[order]
                row, shift = parse(data[tn.ranges(off[:-1][order], size)], np.append(0, np.cumsum(size)), unit.length)
                at = order[row]
                yield pa.RecordBatch.from_arrays([k.take(pa.array(at)), pa.array((s[at] + shift).astype(np.int32))], ["k", "p"])

        return run


def substring_dedup(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", hot: int = 5_000) -> DataFrame:
    """Remove words of windows that already stand earlier in the corpus.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one
    document.  Earlier means a smaller id, or an earlier start in the same
    document.  Windows are judged on the input.  Returns doc_id, n_words,
    n_removed, spans (first and last removed word of each run) and kept_text
    (kept words joined by one space).

    The corpus is cut into reference blocks by the least 8-gram of each window,
    so a document meets the blocks that can hold its windows.  In each block its
    segments are parsed greedily into factors that stand earlier; factors of
    `window` words or more are duplicate spans.

    Corner cases: null and empty texts have no words; texts under `window`
    words lose nothing; rows without an id are known by their text and ordered
    by its hash, and of equal ones the first stays; rows with one id and the
    same text stand for one document and get the same result; texts that share
    an id are documents of their own, ordered by hash; other columns are
    ignored; an empty table gives an empty result.  A task that runs again must
    read its rows in the same order, as scans of files do.
    """
    unit = repeats.Unit(words=True, length=window, k=min(8, window), hot=hot)
    marked = repeats.marked(docs, doc_id, text, unit, Parse())
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept_text string"
    return marked.mapInArrow(_keep(window), schema)


def _keep(window: int):
    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                data, off = tn.flat(piece.column("text"))
                w = tn.Words(data, off)
                gone = repeats.covered(piece, w.bounds, window)
                edge, first, end = repeats.spans(gone, w.bounds)
                removed = np.diff(np.append(0, np.cumsum(gone))[w.bounds])
                # the kept words of a document with a space between them
                stay = np.flatnonzero(~gone)
                owner = np.repeat(np.arange(len(w.count)), w.count)[stay]
                text, start, stop = w.joined(data)
                size = stop[stay] - start[stay] + 1
                if len(stay):
                    size[np.append(owner[1:] != owner[:-1], True)] -= 1
                kept = text[tn.ranges(start[stay], size)]
                total = np.bincount(owner, weights=size, minlength=len(w.count)).astype(np.int64)
                at = np.append(0, np.cumsum(total)).astype(np.int32)
                texts = pa.Array.from_buffers(pa.string(), len(w.count), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))])
                parts = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array((end - 1).astype(np.int32))], ["first", "last"])
                found = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), found, texts], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return emit
