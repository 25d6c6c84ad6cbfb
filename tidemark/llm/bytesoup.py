"""Words and word hashes of whole batches of texts with numpy, straight from Arrow's buffers.

A text is its UTF-8 bytes. Word bytes are digits, letters and all bytes from 0x80, so the words
are those of common.WORD. A word's hash is a polynomial of random byte values modulo 2**64,
taken from one running sum over the batch, and then mixed; it doesn't depend on the word's place.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_LOW = np.arange(256)
_LOW[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOW]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches, giving back to the system what it freed: workers stay on idle between tasks."""

    @functools.wraps(run)
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def chunks(offs: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row that has more."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin (one more at the end)."""
    mask = is_word[data]
    before = np.zeros(len(mask) + 1, bool)
    before[1:] = mask
    after = np.zeros(len(mask) + 1, bool)
    after[:-1] = mask
    before[offs] = False
    after[offs] = False
    starts = np.flatnonzero(mask & ~before[:-1])
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_VALUE[data], starts, ends)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of values."""
    power, inverse = _power(len(values) + 1)
    running = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row, and where each row's begin. A row of 1 to n-1 words has one: all its words."""
    counts = np.diff(first)
    total = len(hashes)
    out = np.zeros(total, U64)
    for k in range(n):
        factor = U64(pow(0xA0761D6478BD642F | 1, k + 1, 2**64))
        out[: max(0, total - k)] += hashes[k:] * factor
    short = (counts > 0) & (counts < n)
    keep = np.zeros(total, bool)
    size = np.where(counts >= n, counts - n + 1, np.where(short, 1, 0))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    if begin[-1]:
        keep = np.repeat(first[:-1] - begin[:-1], size) + np.arange(begin[-1])
        out = out[keep]
        for row in np.flatnonzero(short):
            h = hashes[first[row] : first[row + 1]]
            out[begin[row]] = sum((int(x) * pow(0xA0761D6478BD642F | 1, k + 1, 2**64) for k, x in enumerate(h)), len(h)) % 2**64
    else:
        out = out[:0]
    return mix(out), begin
