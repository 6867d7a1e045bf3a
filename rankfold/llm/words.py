"""Words and word shingles of whole Arrow string columns, hashed with array operations.

A word is a run of bytes other than space and the five control characters from tab to carriage return; A-Z is
lower-cased. Work goes in blocks of a few megabytes of text, so memory follows the block or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_STEP = mix(np.arange(1001, 1065, dtype=np.uint64) * _U(_BASE)) | _U(1)


class Block(NamedTuple):
    """Words of rows `lo` to `hi`: hash, first byte, byte after the last; row r owns words first[r]:first[r + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row limits in them; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Words of a string column, a few rows at a time; rows are whole."""
    data, limits = text_bytes(column)
    lo, n = 0, len(limits) - 1
    powers = inverse = np.zeros(0, np.uint64)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + block_bytes, side="right")) - 1)
        part, cuts = LOWER[data[limits[lo]:limits[hi]]], limits[lo:hi + 1] - limits[lo]
        if len(part) + 1 > len(powers):
            powers, inverse = _powers(_BASE, len(part) + 1), _powers(_INVERSE, len(part) + 1)
        inside = ~SPACE[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = cuts[(cuts > 0) & (cuts < len(part))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * powers[:len(part)], out=running[1:])
        hashes = mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        yield Block(lo, hi, part, hashes, starts, ends, np.searchsorted(starts, cuts))
        lo = hi


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, the word each begins at, and the limits of each row's shingles.

    A row of fewer words has its whole sequence as the only shingle; a row without words has none.
    """
    count = np.diff(block.first)
    windows = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    limits = np.concatenate([[0], np.cumsum(windows)])
    begin = np.arange(limits[-1]) - np.repeat(limits[:-1] - block.first[:-1], windows)
    total = np.zeros(len(begin), dtype=np.uint64)
    length = np.repeat(np.minimum(count, k), windows)
    padded = np.concatenate([block.hashes, np.zeros(k, np.uint64)])
    for i in range(k):
        total += np.where(i < length, padded[begin + i] * _STEP[i], _U(0))
    return mix(total + length.astype(np.uint64)), begin, limits
