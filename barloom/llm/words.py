"""Words, shingles and their 64-bit hashes, computed for a whole Arrow column at once.

A word is a run of bytes outside space and U+0009 to U+000D; A to Z are lower-cased. All functions
work on UTF-8 bytes, so whole texts of any length are read and no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; another seed gives another hash."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by one sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls read as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, rows)
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin (rows + 1 positions)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * power[:len(data)])])
    values = (total[ends] - total[starts]) * inverse[starts]
    values = mix(values, 1) + (ends - starts).astype(np.uint64)
    return mix(values, 2), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in order, and where each row's runs begin.

    A row of fewer words, but at least one, has one run of all its words.
    """
    counts = np.diff(begins)
    runs = np.maximum(counts - width + 1, np.minimum(counts, 1))
    out_begins = np.concatenate([[0], np.cumsum(runs)])
    factors = mix(np.arange(width, dtype=np.uint64), 3) | np.uint64(1)
    rows = np.repeat(np.arange(len(counts)), runs)
    first = begins[:-1][rows] + np.arange(out_begins[-1]) - out_begins[:-1][rows]
    length = np.minimum(counts, width)[rows].astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = length.copy()
    for i in range(width):
        part = padded[first + i] * factors[i]
        total += part if i == 0 else np.where(length > i, part, np.uint64(0))
    return mix(total, 4), out_begins
