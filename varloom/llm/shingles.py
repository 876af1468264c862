"""Words and word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

Words are runs of bytes other than space and 0x09 to 0x0D, after A-Z is lower-cased. A word's
hash adds, for each byte, a random odd number for the byte times one for its place; all
arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from varloom.llm.common import text_buffers

_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEED.integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and the n + 1 bounds of each text."""
    raw, off = text_buffers(column)
    hashes, starts = runs(LOWER[raw], off, SPACE)
    return hashes, np.searchsorted(starts, off)


def runs(low: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and first bytes of all runs of bytes that are not ``space``, within texts."""
    if len(low) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~space[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(low)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    number = np.cumsum(begins)[at] - 1
    place = at - starts[number]
    value = _BYTE[low[at]] * _PLACE[place & 0xFFF]
    far = place >> 12
    if far.any():  # very long words: the place table repeats with another factor
        value *= far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2) + np.uint64(1)
    heads = np.searchsorted(at, starts)
    return mix(np.add.reduceat(value, heads)), starts


def sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and the n + 1 bounds of each text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    word, bounds = words(column)
    count = np.diff(bounds)
    sizes = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    short = np.flatnonzero((count > 0) & (count < width))
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    head = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], sizes)
    value = np.zeros(ends[-1], np.uint64)
    for k in range(width):
        value += padded[head + k] * _STEP[k]
    for i in short:
        own = word[bounds[i] : bounds[i + 1]]
        value[ends[i]] = np.sum([*(own * _STEP[: len(own)]), _STEP[32 + len(own)]], dtype=np.uint64)
    value = mix(value)
    for a, b in zip(ends[:-1], ends[1:]):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = value[1:] != value[:-1]
    keep[ends[:-1][sizes > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return value[keep], total[ends]
