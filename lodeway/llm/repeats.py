"""Routing of repeated passages, shared by substring and suffix-array dedup.

Every window of `length` symbols is filed under the hash of its least k-gram;
consecutive windows with the same least k-gram form one run.  Equal windows
share the key, so only keys with two runs or more can hold repeats.  Those
runs travel with their symbols to the block of their key, where a kernel parses
or sorts them.  Of equal segments one goes on.

No block grows with a common passage.  A task that meets a key often spreads
its further runs over all partitions by a salt and leaves a marker under the
key.  The segments of keys so marked, or with more than `hot` runs, go apart:
where more than `hot` different ones of a key are left, these are cut again by
a longer k-gram, at last by whole windows, of which a key has one.

The kernels answer with the windows that stay; all other windows of the
repeated runs are repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .keys import cut, key_type, keyed, release

SHARD_BYTES = 2 << 20
CROWD = 256  # runs of a key in one task from which on they are spread, besides four times the mean
COUNTERS = 1 << 21
REACH_BITS = 16


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how long a window is and how long the k-gram that routes it."""

    words: bool
    length: int
    k: int
    hot: int = 5_000

    def symbols(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            w = tn.Words(data, off)
            return w.hash, w.bounds
        return data, off

    def grams(self, symbol: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return (tn.grams if self.words else tn.byte_grams)(symbol, bounds, k)

    def runs(self, symbol: np.ndarray, bounds: np.ndarray, k: int):
        return tn.runs(*self.grams(symbol, bounds, k), bounds, k, self.length)


def _runs(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows m, salt, k, se of the runs; one with se = -1 is the marker of a key that the task meets often.

    se packs the first window and how many follow it; a run ends within `length` symbols.
    """

    def emit(batches):
        load, met = np.zeros(COUNTERS, np.int32), 0
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                symbol, bounds = unit.symbols(*tn.flat(piece.column("text")))
                doc, s, e, key = unit.runs(symbol, bounds, unit.k)
                slot = (key % tn.U64(COUNTERS)).astype(np.int64)
                np.add.at(load, slot, 1)
                met += len(key)
                many = load[slot] > CROWD + 4 * met // COUNTERS
                salt = np.where(many, (tn.mix(key ^ (tn.U64(met) + np.arange(len(key)).astype(tn.U64))) >> tn.U64(33)).astype(np.int32) | 1, 0)
                marks, at = np.unique(key[many], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), piece.column("k").take(pa.array(doc)), pa.array(s << REACH_BITS | (e - s))], ["m", "salt", "k", "se"])
                if len(marks):
                    zero = np.zeros(len(marks), np.int32)
                    some = piece.column("k").take(pa.array(doc[many][at]))
                    yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(zero), some, pa.array(zero.astype(np.int64) - 1)], ["m", "salt", "k", "se"])

    return emit


def list_rows(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each element of a list column, and the elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_parent_indices(column).to_numpy().astype(np.int64), pc.list_flatten(column)


def field(structs: pa.Array, name: str) -> np.ndarray:
    return pc.struct_field(structs, name).to_numpy(zero_copy_only=False)


def binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Array of the pieces data[start : start + size]."""
    off = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[tn.ranges(start, size)]))])


def _segments(unit: Unit, data: np.ndarray, off: np.ndarray):
    """Symbols of a slice, their bounds, and a function from ranges of symbols to their bytes; words joined by one space."""
    if not unit.words:
        return data, off, lambda a, b: binary(data, a, b - a)
    w = tn.Words(data, off)
    text, start, end = w.joined(data)
    return w.hash, w.bounds, lambda a, b: binary(text, start[a], end[b - 1] - start[a])


def _payload(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows m, seg, k, s of the runs in `parts`."""

    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                symbol, bounds, pieces = _segments(unit, *tn.flat(piece.column("text")))
                row, parts = list_rows(piece.column("parts"))
                m, s, more = (field(parts, c) for c in ("m", "s", "more"))
                a = bounds[row] + s
                seg = pieces(a, a + more + unit.length)
                yield pa.RecordBatch.from_arrays([pa.array(m), seg, piece.column("k").take(pa.array(row)), pa.array(s), pa.array(np.ones(len(s), bool))], ["m", "seg", "k", "s", "once"])

    return emit


def _recut(unit: Unit, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments cut into the runs of a longer k-gram."""

    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "seg"):
                symbol, bounds, pieces = _segments(unit, *tn.flat(piece.column("seg")))
                row, s, e, key = unit.runs(symbol, bounds, k)
                at = pa.array(row)
                a = bounds[row] + s
                seg = pieces(a, a + (e - s) + unit.length)
                place = pa.array((piece.column("s").to_numpy()[row] + s).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), seg, piece.column("k").take(at), place, piece.column("once").take(at)], ["m", "seg", "k", "s", "once"])

    return emit


def _cooled(rows: DataFrame, unit: Unit, distinct: Callable, schema: str) -> DataFrame:
    """Different segments of hot keys, cut by ever longer k-grams until no key has more than `hot`."""
    rows, done, k = cut(rows), None, unit.k
    while k < unit.length:
        over = rows.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > unit.hot).select("m")
        over = cut(over)
        if over.isEmpty():
            break
        cool = rows.join(over, "m", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        k = (k + unit.length + 1) // 2
        rows = cut(distinct(rows.join(over, "m", "left_semi").mapInArrow(_recut(unit, k), schema)))
    return rows if done is None else done.unionByName(rows)


def sort_keys(k: pa.Array) -> list[np.ndarray]:
    """Keys of rows as arrays for lexsort, the last one first in rank."""
    if pa.types.is_struct(k.type):
        return [field(k, "v"), field(k, "i")]
    return [k.to_numpy()]


def blocks(batches: Iterator[pa.RecordBatch], limit: int, at_keys: bool) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes of segments from rows sorted by m, cut between keys or anywhere."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        m = batch.column("m").to_numpy()
        total = np.cumsum(pc.binary_length(batch.column("seg")).to_numpy().astype(np.int64))
        if not len(m):
            continue
        may = np.append(True, m[1:] != m[:-1]) if at_keys else np.ones(len(m), bool)
        if at_keys and held:
            may[0] = held[-1].column("m")[-1].as_py() != m[0]
        border = np.flatnonzero(may)
        ahead = np.append(0, total[:-1])[border]  # bytes of this batch before each border
        start, before = 0, 0
        while (i := int(np.searchsorted(ahead, before + limit - size))) < len(border):
            b = int(border[i])
            if b > start:
                held.append(batch.slice(start, b - start))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, size, start, before = [], 0, b, int(ahead[i])
        held.append(batch.slice(start))
        size += int(total[-1] - before)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def documents(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (k, doc_id, text, times), (k, first) of the texts that another row has too, and whether some rows have no id.

    A row is known by its id, by id and text where one id has several texts, and
    by its text where it has no id.  Equal rows without ids are one row with
    their number in `times`.  first: the row has the least key of its copies.
    """
    rows = keyed(docs, doc_id, text)
    named = rows.select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    nameless = not docs.where(docs[doc_id].isNull()).isEmpty()
    if nameless:
        lone = rows.where("doc_id is null").groupBy("text").agg(F.count("*").alias("times"))
        named = named.where("doc_id is not null").unionByName(lone.select(F.lit(None).cast("long").alias("doc_id"), "text", "times"))
    body = F.coalesce("text", F.lit(""))
    ident, v = F.coalesce("doc_id", F.xxhash64("text")), F.xxhash64("text")
    ids = cut(named.select(ident.alias("i"), v.alias("v"), "times", F.xxhash64(body).alias("a"), F.xxhash64(F.lit(7), body).alias("b"), F.octet_length(body).alias("n")))
    wide = not ids.groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").isEmpty()
    k = F.struct("i", "v") if wide else F.col("i")
    ids = ids.select(k.alias("k"), "times", "a", "b", "n")
    groups = ids.groupBy("a", "b", "n").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("times").alias("most")).where("low < high or most > 1").select("a", "b", "n", "low")
    copies = cut(ids.join(groups, ["a", "b", "n"]).groupBy("k").agg(F.min(F.col("k") == F.col("low")).alias("first")))
    own = F.struct(ident.alias("i"), v.alias("v")) if wide else ident
    return named.select(own.alias("k"), "doc_id", "text", "times"), copies, nameless


def marked(docs: DataFrame, doc_id: str, text: str, unit: Unit, kernel) -> DataFrame:
    """Rows doc_id and text with `parts`, the repeated runs, `stay`, the windows in them that stay, and `whole`.

    parts is null where nothing of the document repeats; whole is true where
    every window does, as in a copy of another document.  Copies of one text
    are found first and only the one with the least key sends its runs.
    """
    docs, copies, nameless = documents(docs, doc_id, text)
    key = key_type(docs)
    runs = docs.mapInArrow(_runs(unit), f"m long, salt int, k {key}, se long")
    runs = runs.where("m is not null and salt is not null and k is not null and se is not null").repartition("m", "salt")
    # asks for every column, so that both sides of the join read one and the same exchange
    met = runs.groupBy("m", "salt").agg(F.count("*").alias("n"), F.min("se").alias("low"), F.max("k").alias("_k"))
    met = met.where("(n > 1 or salt <> 0) and low is not null and _k is not null")
    met = met.select("m", "salt", ((F.col("n") > unit.hot) | (F.col("salt") != 0) | (F.col("low") < 0)).alias("warm"))
    run = F.struct("m", F.shiftright("se", REACH_BITS).cast("int").alias("s"), F.col("se").bitwiseAND((1 << REACH_BITS) - 1).cast("int").alias("more"), "warm")
    parts = runs.join(met, ["m", "salt"]).groupBy("k").agg(F.filter(F.collect_list(run), lambda p: p.s >= 0).alias("parts"))
    parts = cut(parts.join(copies.where("not first").select("k"), "k", "left_anti"))
    placed = docs.repartition("k")
    schema = f"m long, seg binary, k {key}, s int, once boolean"

    def sent(own: DataFrame) -> DataFrame:
        return placed.join(own.where("size(parts) > 0"), "k").mapInArrow(_payload(unit), schema)

    def stays(segments: DataFrame) -> DataFrame:
        return segments.sortWithinPartitions("m").mapInArrow(kernel.emit(unit), f"k {key}, p int")

    # what counted the runs is done with
    del runs, met
    release(docs)
    pick = lambda warm: parts.select("k", F.filter("parts", lambda p: p.warm == F.lit(warm)).alias("parts"))
    extra = None
    if not parts.where(F.exists("parts", lambda p: p.warm)).isEmpty():
        extra = _cooled(kernel.distinct(sent(pick(True))), unit, kernel.distinct, schema)
        release(docs)
        extra = stays(extra.repartition("m"))
    # a cool key has at most `hot` rows, so equal segments may meet in its own partition
    stay = stays(kernel.distinct(sent(pick(False)).repartition("m")))
    stay = (stay if extra is None else stay.unionByName(extra)).groupBy("k").agg(F.collect_list("p").alias("stay"))
    whole = copies.select("k", kernel.whole(F.col("first")).alias("whole")).where("whole")
    shown = parts.select("k", F.transform("parts", lambda p: F.struct(p.s.alias("s"), p.more.alias("more"))).alias("parts"))
    out = placed.join(shown, "k", "left").join(stay, "k", "left").join(whole, "k", "left")
    copy = F.coalesce("whole", F.lit(False))
    if not nameless:
        return out.select("doc_id", "text", "parts", "stay", copy.alias("whole"))
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "text", "parts", "stay", (copy | (F.col("turn") > 1)).alias("whole"))


def covered(piece: pa.RecordBatch, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which symbols of a slice lie in a repeated window."""
    n = int(bounds[-1])
    size = np.diff(bounds)
    starts = np.zeros(n + 1, bool)
    row, parts = list_rows(piece.column("parts"))
    s, more = field(parts, "s").astype(np.int64), field(parts, "more").astype(np.int64)
    starts[tn.ranges(bounds[:-1][row] + s, more + 1)] = True
    row, p = list_rows(piece.column("stay"))
    starts[bounds[:-1][row] + p.to_numpy(zero_copy_only=False).astype(np.int64)] = False
    whole = np.flatnonzero(piece.column("whole").to_numpy(zero_copy_only=False).astype(bool) & (size >= length))
    starts[tn.ranges(bounds[:-1][whole], size[whole] - length + 1)] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts[:n])
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def spans(gone: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed symbols within each document: how many up to each bound, first and end within the document."""
    n = len(gone)
    head, tail = gone.copy(), gone.copy()
    head[1:] &= ~gone[:-1]
    tail[:-1] &= ~gone[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    head[inner] |= gone[inner]
    tail[inner - 1] |= gone[inner - 1]
    first, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    edge = np.searchsorted(first, bounds)
    base = np.repeat(bounds[:-1], np.diff(edge))
    return edge, first - base, end - base
