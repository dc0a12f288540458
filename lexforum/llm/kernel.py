"""Numpy text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes that Arrow hands over: a batch of texts is
one byte array with document offsets, and words, hashes and windows are found
for the whole batch with array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call holds at most (one longer text is a call of its own).
BLOCK_BYTES = 2 << 20
#: Steps in which tables of powers grow; a worker keeps them, 32 bytes for each byte of its longest block.
POWERS_STEP = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> _S30)) * _M1
    h = (h ^ (h >> _S27)) * _M2
    return h ^ (h >> _S31)


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1 + seed, 257 + seed, dtype=np.uint64) * _BASE)


_VALUES = _byte_values(0)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_VALUES_2 = _byte_values(1000)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // POWERS_STEP) * POWERS_STEP
            up, down = np.full(size, self.base), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


@lru_cache(maxsize=2)
def _powers(base: int) -> _Powers:
    return _Powers(base)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """64-bit polynomial hash of every slice data[starts:ends] (not empty), independent of its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(0xD1342543DE82EF95 if second else 0x9E3779B97F4A7C15).to(len(data) + 1)
    values = (_VALUES_2 if second else _VALUES_LOWER if lower else _VALUES)[data]
    values *= up[: len(data)]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, each with at most `size` bytes of text (or one text), with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the number of them before each document (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the number of words before each document."""
    starts, ends, before = words(data, off)
    return slice_hashes(data, starts, ends, lower=True), before


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 for each i, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each i; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, index of one occurrence of each, and the position of every value among them."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(new) - 1
    return s[new], order[new], rank
