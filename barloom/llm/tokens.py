"""Words of ASCII letters, digits and all other characters beyond ASCII, for a whole Arrow column.

A to Z are lower-cased; every other ASCII character separates words. All functions work on UTF-8
bytes, so whole texts of any length are read and no Python string is made per word.
"""

from __future__ import annotations

import zlib

import numpy as np

from .words import _powers, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _INSIDE[ord(_first):ord(_last) + 1] = True

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and where each row's words begin (rows + 1 positions)."""
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of lower-cased bytes."""
    power, inverse = _powers(len(lower) + 1)
    wide = lower.astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power[:len(lower)])])
    values = (total[ends] - total[starts]) * inverse[starts]
    return mix(mix(values, 1) + (ends - starts).astype(np.uint64), 2)


def crc32(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None,
          longest: int = 48) -> np.ndarray:
    """CRC-32 of each word, or of what has the CRC ``before`` followed by the word.

    All words advance together, one byte a step; those over ``longest`` bytes go one by one.
    """
    out = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    sizes = ends - starts
    for i in np.flatnonzero(sizes > longest):
        out[i] = zlib.crc32(lower[starts[i]:ends[i]], int(out[i]))
    order = np.flatnonzero(sizes <= longest)
    order = order[np.argsort(-sizes[order], kind="stable")]
    at, state, counts = starts[order], ~out[order], -sizes[order]
    for step in range(int(-counts[0]) if len(order) else 0):
        n = int(np.searchsorted(counts, -step))
        part = state[:n]
        state[:n] = CRC[(part ^ lower[at[:n] + step]) & 0xFF] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out
