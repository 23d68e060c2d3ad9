"""Words, shingles and hashes of whole texts, computed on Arrow buffers with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. These separators are ASCII, so cutting
UTF-8 bytes gives the same words as cutting code points. Hashes are 64-bit and the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values which spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(ends):
        ends = np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "t", rows: int = 1000,
           size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows whose texts have about `size` bytes at most, one row at
    least: what a task holds follows from the longest text and not from the number of rows."""
    for whole in batches:
        _, ends = utf8(whole.column(column))
        at = 0
        while at < whole.num_rows:
            upto = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            upto = min(max(upto, at + 1), at + rows, whole.num_rows)
            yield whole.slice(at, upto - at)
            at = upto


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 bounds of the rows' words."""
    space = _SPACE[data]
    first = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    starts = np.flatnonzero(first & before)
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = True
    ends = np.flatnonzero(first & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _BASE)])
    return _POWERS[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial from prefix sums, moved to one origin and mixed.

    The ranges are shifted to the power of their own start by multiplying with that of the
    distance to the end of the piece; pieces of 256 KB keep the tables small.
    """
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        upto = max(int(np.searchsorted(ends, lo + step, "right")), at + 1)
        hi = int(ends[upto - 1])
        n = hi - lo
        p = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * p[:n], out=total[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        out[at:upto] = (total[e] - total[s]) * p[n - s]
        # All ranges of a piece now carry the factor BASE ** n; take it out again.
        out[at:upto] *= np.uint64(pow(int(p[n]), -1, 1 << 64))
        out[at:upto] += (e - s).astype(np.uint64) * _BASE
        at = upto
    return mix(out)


def words(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the rows, and the n + 1 bounds of the rows' words."""
    data, offsets = utf8(column)
    if lower:
        data = _LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    return hash_spans(data, starts, ends), bounds


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each row, ascending, and the n + 1 bounds of the rows' sets.

    A row of fewer words than `size` has its whole sequence as its one shingle, one without words none.
    """
    n_words = np.diff(bounds)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled[:n - k] += hashes[k:] * (_powers(size + 1)[k + 1])
    rolled = mix(rolled)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][row]
    value = rolled[at]
    for r in np.flatnonzero((n_words > 0) & (n_words < size)):
        own = hashes[bounds[r]:bounds[r + 1]]
        value[np.searchsorted(row, r)] = mix(np.array([(own * _powers(size + 1)[1:len(own) + 1]).sum()
                                                      + np.uint64(len(own))], np.uint64))[0]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """MinHash signatures, one row per non-empty set: the smallest of the shingles under each factor."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(filled), size), np.uint64)
    if not len(filled):
        return out
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    starts = bounds[:-1][filled]
    for k in range(size):
        out[:, k] = np.minimum.reduceat(values * factors[k], starts)
    return out
