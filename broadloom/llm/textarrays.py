"""Texts of an Arrow batch as flat numpy arrays: words and shingles with 64-bit hashes.

All functions work on whole texts. A batch is cut into chunks of whole texts, so that the
working memory of a task is bounded by a chunk (or by its longest text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
        if len(have) > 2 * CHUNK_BYTES + 1:  # a huge text must not stay in memory
            del _POWERS[base]
    return have[:n]


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each pair; equal content gives equal hashes."""
    n = len(symbols)
    sums = np.zeros(n + 1, np.uint64)
    weighted = symbols.astype(np.uint64)
    weighted += _U(1)
    weighted *= powers(_BASE, n)
    np.cumsum(weighted, out=sums[1:])
    del weighted
    content = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(content ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, UTF-8 bytes, offsets) of runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        at = offsets[first : last + 1]
        yield first, last - first, data[at[0] : at[-1]], at - at[0]
        first = last
    release()


def strings(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of a column, with few of them as Python strings at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()
    release()


def grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of sorted rows with equal values in these columns, as slices."""
    kept: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        keys = list(zip(*(batch.column(name).to_pylist() for name in names), strict=True))
        first = 0
        for i, key in enumerate(keys):
            if key != group:
                if i > first:
                    kept.append(batch.slice(first, i - first))
                if kept:
                    yield kept
                kept, first, group = [], i, key
        if len(keys) > first:
            kept.append(batch.slice(first))
    if kept:
        yield kept


def release() -> None:
    """Give memory that is no longer used back: workers live on and share a small executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words: everything but ASCII white space.
SPACED = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words: ASCII letters and digits and everything beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of some texts: hash of the lower-cased word, and first word of each text."""

    hashes: np.ndarray
    first: np.ndarray  # one more than texts


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Lower-case A-Z and cut each text into its longest runs of the bytes in ``table``."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(range_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets))


def words_in_parts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The same as ``words``, with working memory for ``CHUNK_BYTES`` (or the longest text) only."""
    hashes, first, low = [], [np.zeros(1, np.int64)], 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(offsets) - 1)
        part = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], table)
        hashes.append(part.hashes)
        first.append(part.first[1:] + first[-1][-1])
        low = high
    return Words(np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(first))


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of ``width`` consecutive words, per text.

    Fewer words make one shingle of them all; a text without words has an empty set.
    """
    steps = powers(0xC2B2AE3D27D4EB4F, max(width, 1))
    h, n = found.hashes, len(found.hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        rolled += h[j : j + len(rolled)] * steps[j]
    rolled = mix(rolled + _U(width))
    for first, last in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        k = last - first
        if k >= width:
            own = np.sort(rolled[first : last - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif k:
            yield mix((h[first:last] * steps[:k]).sum(dtype=np.uint64, keepdims=True) + _U(k))
        else:
            yield np.zeros(0, np.uint64)
