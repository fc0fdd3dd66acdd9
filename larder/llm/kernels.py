"""Vectorised work on the bytes of a batch of texts.

A batch is one byte array with the offsets of its texts. Words are runs of bytes other than 0x20 and 0x09-0x0D; as the bytes
of a multi-byte character are all above 0x7F, this equals the same rule on characters.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLACK = np.ones(256, bool)
BLACK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, U64)
_BASE = U64(0x9E3779B97F4A7C15)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def parts(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the index of each text's first word (one entry more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    black = BLACK[data]
    head, tail = black.copy(), black.copy()
    head[1:] &= ~black[:-1]
    tail[:-1] &= ~black[1:]
    at = offsets[:-1][offsets[:-1] < n]
    head[at] = black[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    tail[at] = black[at]
    begin = np.flatnonzero(head)
    return begin, np.flatnonzero(tail) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, after A-Z became a-z if ``lower``."""
    if len(begin) == 0:
        return np.zeros(0, U64)
    size = end - begin
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    x = data[within + np.repeat(begin, size)]
    x = (LOWER[x] if lower else x).astype(U64) + U64(1)
    x *= powers(int(size.max()))[within]
    return mix(np.add.reduceat(x, first) + size.astype(U64) * U64(0xA0761D6478BD642F))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the index of each text's first (one entry more than texts).

    ``short``: a text of 1 to k-1 words has one for its whole sequence; else it has none.
    """
    n = np.diff(first)
    made = np.where(n >= k, n - k + 1, (n > 0) if short else 0).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(made)))
    if start[-1] == 0:
        return np.zeros(0, U64), start
    c = seeds(k, 11)
    at = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], made)
    padded = np.concatenate((h, np.zeros(k, U64)))
    out = padded[at] * c[0]
    for j in range(1, k):
        out += padded[at + j] * c[j]
    if short:
        for i in np.flatnonzero((n > 0) & (n < k)):
            own = h[first[i] : first[i + 1]]
            out[start[i]] = np.append(own * c[: len(own)], np.full(len(own), 0xE7037ED1A0B428DB, U64)).sum(dtype=U64)
    return mix(out), start


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def release() -> None:
    """Gives memory that is free back to the system: a worker is kept for other tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives memory back at its end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
