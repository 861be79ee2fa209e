"""Vectorised byte and shingle kernels over Arrow string columns.

Every kernel works on the UTF-8 buffer of whole texts, many documents at a
time, in slices of a bounded number of bytes (a longer document forms a slice
by itself), so memory doesn't depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
WORDS = 5  # words of a shingle
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TAP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 1
_MASK = (1 << 64) - 1
_BACK = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE_LOWER = _BYTE[LOWER]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, (n - 1).bit_length()), _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and each text's first word."""
    lo, hi = int(at[0]), int(at[-1])
    inside = ~SPACE[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[at - lo] = True
    n = hi - lo
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, at - lo)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE_LOWER) -> np.ndarray:
    """64-bit hashes of byte spans inside one slice; equal bytes give equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends.max())
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(table[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
    h = (sums[ends - lo] - sums[starts - lo]) * _power(_BACK, hi - lo + 1)[starts - lo]
    return mix(h + (ends - starts).astype(np.uint64) * _TAP[7])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, and each text's first shingle.

    A text of fewer than ``size`` words (but one) has its whole sequence as its
    only shingle; a text without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(n, out=begin[1:])
    total = int(begin[-1])
    text = np.repeat(np.arange(len(count)), n)
    i = np.arange(total) - begin[text] + first[text]
    h = words[i] * _TAP[0]
    if len(words):
        for k in range(1, size):
            h += words[np.minimum(i + k, len(words) - 1)] * _TAP[k]
    out = mix(h)
    for d in np.flatnonzero((count > 0) & (count < size)):
        w = words[first[d] : first[d + 1]]
        out[begin[d]] = mix((w * _TAP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _TAP[6:7] * _U(len(w)))[0]
    return out, begin


def shingles(data: np.ndarray, at: np.ndarray, size: int = WORDS):
    """Shingle hashes of a slice with each text's first, and the word spans."""
    starts, ends, first = word_spans(data, at)
    h, begin = shingle_hashes(span_hashes(data, starts, ends), first, size)
    return h, begin, starts, ends, first


def sets(column, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    data, at = buffer(column)
    for i, j in slices(at):
        h, begin, *_ = shingles(data, at[i : j + 1], size)
        for d in range(j - i):
            yield np.unique(h[begin[d] : begin[d + 1]])


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many more underscores in front as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lists(values: np.ndarray, at: np.ndarray, kind=None) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
