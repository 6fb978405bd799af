"""Byte-level helpers used inside tasks: Arrow text columns as numpy bytes, words and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task works on at a time; a longer single text makes a piece of its own.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as ``large_binary`` without nulls (null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows, from 0) of a ``large_binary`` column."""
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of a batch whose texts hold at most ``limit`` bytes, or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column on top of ready byte and offset buffers."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    )


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags[0]:
        edges = np.concatenate(([0], edges))
    if flags[-1]:
        edges = np.concatenate((edges, [len(flags)]))
    return edges[::2], edges[1::2]


def powers(count: int, base: int = _BASE) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that sums and products of them are well spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, in blocks so that memory stays small."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        left = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, left + PIECE_BYTES, "right")))
        block = data[left : ends[stop - 1]]
        weights = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * weights[:-1], out=sums[1:])
        low, high = starts[at:stop] - left, ends[at:stop] - left
        back = powers(len(block) + 1, _INVERSE)
        out[at:stop] = (sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64)
        at = stop
    return mixed(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k, weight in enumerate(powers(size + 1)[1:]):
        total += words[k : len(words) - size + 1 + k] * weight
    return mixed(total)
