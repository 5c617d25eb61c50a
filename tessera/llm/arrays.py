"""Word and shingle arithmetic on Arrow text buffers with numpy.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D``.  All of these
bytes are ASCII, so splitting UTF-8 bytes equals splitting code points.  A text
column is walked in slices of a MB, which bounds the memory of a task by the
slice and the longest single text, whatever the batch size is.

Hashes are 64-bit: a polynomial over the bytes of a word, mixed, and a
polynomial over the words of a shingle, mixed again.  Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for base in (_BASE, inverse):
            t = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            t[0] = 1
            out.append(np.cumprod(t))
        _powers[:] = out
    return _powers


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about ``limit`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, bytes_[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends (exclusive) and the row of every word."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= ~solid[1:] | edge[1:-1] if len(data) > 1 else True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes; fold: A-Z count as a-z."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive hashes (rows are not told apart)."""
    m = max(len(hashes) - k + 1, 0)
    acc = np.full(m, k, np.uint64)
    for j in range(k):
        acc = acc * _STEP + hashes[j : j + m]
    return mix(acc)


def doc_shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> Iterator[np.ndarray]:
    """For each row in turn its distinct k-word shingle hashes, sorted; fewer words than k make one shingle."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    every = window_hashes(hashes, k)
    for r in range(n_rows):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-item) array between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
