"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes outside space and \\t..\\r; since all of those are ASCII, working on UTF-8 bytes gives the
same words as working on code points.  A word's hash is a polynomial over its bytes modulo 2**64, read off a prefix sum,
then finalised by a 64-bit mixer, so a batch of texts is hashed without any per-word Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 20
ROWS_AT_ONCE = 512


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n, or more of them, of BASE and of its inverse; up to KEPT_POWERS of them are kept for the next call."""
    if len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    size = 1 << max(16, n.bit_length())
    made = []
    for base in (BASE, BASE_INVERSE):
        row = np.full(size + 1, base)
        row[0] = 1
        made.append(np.multiply.accumulate(row, out=row))
    if size <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def returning_memory(run: Callable) -> Callable:
    """A batch function after whose last batch a task gives freed memory back, since Spark keeps Python workers alive."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


#: Rows of a batch of whole texts sent to a Python worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of BATCH_ROWS rows, unless the session asks for fewer: what either side buffers stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@dataclass
class Words:
    """Words of several texts: byte bounds in ``data``, and for text i the words first[i]:first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = powers(int(self.data.size))
        prefix = np.zeros(self.data.size + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: self.data.size], out=prefix[1:])
        return mix64((prefix[self.end] - prefix[self.start]) * down[self.start])


def text_slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) for runs of rows of at most ``most_bytes``, or one longer row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for begin in range(0, len(texts), ROWS_AT_ONCE):  # so that only a part of a batch is copied at a time
        part = texts.slice(begin, ROWS_AT_ONCE).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(part):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most_bytes, "right")) - 1)
            yield begin + low, begin + high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if data.size else inside
    after = np.concatenate((inside[1:], [False])) if data.size else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, joined, and their bounds.

    A text with fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    w, first = words.hashes(), words.first
    count = np.diff(first)
    out, bounds = [], np.zeros(len(count) + 1, np.int64)
    grams = _fold([w[j : len(w) - k + 1 + j] for j in range(k)]) if len(w) >= k else w[:0]
    for i, n in enumerate(count.tolist()):
        low = first[i]
        if n >= k:
            found = np.unique(grams[low : low + n - k + 1])
        elif n:
            found = _fold([w[low + j : low + j + 1] for j in range(n)])
        else:
            found = w[:0]
        out.append(found)
        bounds[i + 1] = bounds[i] + len(found)
    return (np.concatenate(out) if out else w[:0]), bounds


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), np.uint64(len(columns)))
    for c in columns:
        h = mix64(h * BASE + c)
    return h


def minima(values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """The least value of each segment; ``empty`` for segments without values."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out
