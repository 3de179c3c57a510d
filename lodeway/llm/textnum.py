"""Vectorised numpy views of Arrow text batches: bytes, words, hashes and minimizer runs.

Everything works on one flat byte buffer plus document offsets, so no Python
object is made per word.  Hashes are 64-bit polynomials over a random byte
table, finished with a mixing step; the constants are fixed, so every executor
computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
BASE = 0x9E3779B97F4A7C13 | 3  # BASE - 1 is 2 mod 4, so powers keep almost full order
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
NONE = U64(MASK)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((BASE, INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(length)
    start = 0
    while start < n:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a slice, by default `[^\\x20\\x09-\\x0D]+`: byte bounds, owners and hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, between: np.ndarray = IS_SPACE):
        n = len(data)
        inside = ~between[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        if n:
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, off)  # word range of each document
        self.count = np.diff(self.bounds)
        if n:
            power, inverse = powers(n + 1)
            sums = np.zeros(n + 1, U64)
            np.cumsum((LOWER_TABLE if lower else BYTE_TABLE)[data] * power[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        else:
            self.hash = np.zeros(0, U64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one document."""
        return grams(self.hash, self.bounds, k)

    def joined(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and the byte bounds of each word there."""
        size = self.end - self.start
        text = np.append(data, np.uint8(32))[ranges(self.start, size + 1)]
        after = np.cumsum(size + 1)
        text[after - 1] = 32
        return text, after - 1 - size, after - 1


def grams(symbol: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(symbol)
    out = np.zeros(n, U64)
    last = np.repeat(bounds[1:], np.diff(bounds))
    valid = np.arange(n) + k <= last
    if n >= k:
        acc = symbol[: n - k + 1].copy()
        for j in range(1, k):
            acc *= U64(0xD6E8FEB86659FD93)
            acc += symbol[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out, valid


def byte_grams(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k bytes from each byte on, and whether they lie in one document."""
    n = len(data)
    out = np.zeros(n, U64)
    valid = np.arange(n) + k <= np.repeat(off[1:], np.diff(off))
    if n >= k:
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_TABLE[data] * power[:n], out=sums[1:])
        out[: n - k + 1] = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    return out, valid


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of a[i : i + width], clipped at the end."""
    n, span = len(a), 1
    m = a.copy()
    while span * 2 <= width:
        m[: n - span] = np.minimum(m[: n - span], m[span:])
        span *= 2
    if span < width and n > width - span:
        shift = width - span
        m[: n - shift] = np.minimum(m[: n - shift], m[shift:])
    return m


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of a[i : i + width], clipped at the end."""
    n, span = len(a), 1
    m, at = a.copy(), np.arange(n)

    def meet(shift: int) -> None:
        right = m[shift:] < m[: n - shift]
        at[: n - shift] = np.where(right, at[shift:], at[: n - shift])
        m[: n - shift] = np.where(right, m[shift:], m[: n - shift])

    while span * 2 <= width and n > span:
        meet(span)
        span *= 2
    if span < width and n > width - span:
        meet(width - span)
    return at


POSITION_BITS = 24


def runs(gram: np.ndarray, valid: np.ndarray, bounds: np.ndarray, k: int, length: int):
    """Runs of windows of `length` symbols that share the place of their least k-gram.

    Equal windows hold their least k-gram at the same place, so they fall under
    equal keys wherever they stand.  Ties take the leftmost.  Returns document
    index, first and last window start within the document, and key.
    """
    n = len(gram)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    here = np.arange(n) - bounds[:-1][doc] if n else np.zeros(0, np.int64)
    at = np.flatnonzero(here + length <= size[doc]) if n else here
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    low = U64((1 << POSITION_BITS) - 1)
    order = np.where(valid, gram | low, NONE)
    if size.max() <= int(low):
        order = np.where(valid, (gram & ~low) | here.astype(U64), NONE)
        where = (sliding_min(order, length - k + 1)[at] & low).astype(np.int64) + bounds[:-1][doc[at]]
    else:
        where = sliding_argmin(order, length - k + 1)[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = where[1:] != where[:-1]
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    return doc[at[head]], here[at[head]], here[at[tail]], gram[where[head]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), then start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count)
    return np.arange(total) + shift
