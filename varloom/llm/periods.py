"""Periodic runs of words by internal pattern matching, and texts without the repetitions.

Names of all stretches of 2^k words come from prefix doubling; the order that they give is the
suffix array as far as it is needed, and every name is an interval of it. For each block of
B = 2^k words that begins at a multiple of B, the window of the next B to 2B - 1 words is asked
for further occurrences: a wavelet matrix over the suffix array gives the smallest position not
below a bound within the block's interval. The occurrences in such a window are an arithmetic
progression.

A run of smallest period q, B <= q < 2B, and at least 4q words holds a block in its first
period and that block again q words on. If the window has one or two occurrences, q is the
distance of one of them. If it has more, their difference r is a period of the block; then the
stretch of period r that begins at the block ends q words before the one of the progression
does. All candidates are extended both ways by comparing names, so that only true runs are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm import shingles
from varloom.llm.common import binary_rows, small_batches, text_buffers


class Names:
    """Names of all stretches of 2^k words of several texts, equal for equal stretches.

    ``levels[k][i]`` names the 2^k words from i on: it is the place in ``order`` where the
    interval of this name begins. Stretches of different texts, and those that would pass the
    end of a text, never share a name. There are as many levels as any name is shared.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n = len(words)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        _, word = np.unique(words, return_inverse=True)
        key = text * (word.max(initial=0) + 1) + word
        self.order = np.argsort(key, kind="stable")
        slot, place = np.arange(n), self.order
        name = np.full(n + 1, -1, np.int64)
        self.levels: list[np.ndarray] = []
        step, key = 1, key[self.order]
        while True:
            first = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(np.append(first, len(key)))
            name[place] = np.repeat(slot[first], size)
            shared = np.repeat(size > 1, size)
            slot, place = slot[shared], place[shared]
            if not len(place):
                break
            self.levels.append(name.astype(np.int32 if n < 1 << 31 else np.int64))
            after = place + step
            follow = np.where(after < end[place], name[np.minimum(after, n)] + 1, 0)
            key = name[place] * (n + 1) + follow
            by = np.argsort(key, kind="stable")
            key, place = key[by], place[by]
            self.order[slot] = place
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += same
            j += same
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = i - (1 << k), j - (1 << k)
            name = self.levels[k]
            same = ((x >= 0) & (name[np.maximum(x, 0)] == name[np.maximum(y, 0)])).astype(np.int64) << k
            i -= same
            j -= same
        return start - i


class Successors:
    """A wavelet matrix: the smallest value of an interval that is not below a bound."""

    def __init__(self, values: np.ndarray):
        self.bits = int(values.max(initial=0)).bit_length()
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def _down(self, level: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        zeros = self.zeros[level]
        return np.where(one, zeros[-1] + at - zeros[at], zeros[at])

    def at_least(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each interval [low, high) its smallest value >= bound, or -1."""
        below, left, right = np.zeros(len(low), np.int64), low, high
        for level in range(self.bits):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            zeros = self.zeros[level]
            below += np.where(one, zeros[right] - zeros[left], 0)
            left, right = self._down(level, left, one), self._down(level, right, one)
        found = (below < high - low) & (bound < 1 << self.bits)
        # the value with as many smaller ones in its interval as lie below the bound
        left, right, rest = low, high, np.where(found, below, 0)
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            zeros = self.zeros[level]
            few = zeros[right] - zeros[left]
            one = rest >= few
            rest = np.where(one, rest - few, rest)
            left, right = self._down(level, left, one), self._down(level, right, one)
            value = value << 1 | one
        return np.where(found, value, -1)


def find_runs(
    words: np.ndarray, bounds: np.ndarray, least: int = 6, exponent: int = 4
) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of at least ``least`` words and ``exponent``
    periods, by text, start and period.

    ``words`` holds one number per word of all texts, ``bounds`` where each text begins and ends.
    """
    if exponent < 4:
        raise ValueError("runs of less than four periods may have no block that tells them")
    if len(words) == 0:
        return tuple(np.zeros((4, 0), np.int64))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = bounds[:-1][text]
    names = Names(words, bounds)
    own = np.arange(len(words)) - begin
    tree = Successors(own[names.order])
    starts, periods = [], []
    for k, name in enumerate(names.levels):
        block = 1 << k
        size = np.bincount(name[:-1], minlength=len(words))
        at = np.flatnonzero((own & (block - 1)) == 0)
        at = at[size[name[at]] > 1]
        low = name[at].astype(np.int64)
        high = low + size[low]
        last = own[at] + 2 * block - 1
        one = tree.at_least(low, high, own[at] + block)
        some = (one >= 0) & (one <= last)
        at, low, high, last, one = (x[some] for x in (at, low, high, last, one))
        two = tree.at_least(low, high, one + 1)
        more = (two >= 0) & (two <= last)
        starts += [at, at[more]]
        periods += [one - own[at], two[more] - own[at[more]]]
        # more occurrences: where the two stretches of their difference's period end
        near, far = at[more], at[more] + one[more] - own[at[more]]
        step = two[more] - one[more]
        apart = far + names.forward(far, far + step) - near - names.forward(near, near + step)
        starts.append(near[apart > 0])
        periods.append(apart[apart > 0])
    at, period = np.concatenate(starts), np.concatenate(periods)
    inside = at + period < bounds[1:][text[at]]
    at, period = at[inside], period[inside]
    start = at - names.backward(at, at + period)
    end = at + period + names.forward(at, at + period)
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)  # a stretch has the smallest of its periods
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text[start], start - begin[start], end - start, period


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The bytes of all texts, each word's hash, first byte and end, and the texts' bounds."""
    raw, off = text_buffers(column)
    hashes, starts = shingles.runs(raw, off, shingles.SPACE)
    inside = ~shingles.SPACE[raw]
    ends = np.ones(len(raw), bool)
    if len(raw):
        ends[:-1] = ~inside[1:]
        ends[off[1:][off[1:] > 0] - 1] = True
    return raw, hashes, starts, np.flatnonzero(ends & inside) + 1, np.searchsorted(starts, off)


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of the given words, one space between each two."""
    last = np.zeros(len(start), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    size = end - start + ~last
    until = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(until[-1]) + np.repeat(start - until[:-1], size)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))]
    out[until[1:][~last] - 1] = 32
    return binary_rows(out, until[bounds]).cast(pa.string())


def collapse_runs(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    least: int = 6,
    exponent: int = 4,
    order: Callable[[Any, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """(key, n_words, runs, collapsed) for each row of the table.

    Words are runs of bytes other than space and 0x09 to 0x0D, told apart by hashes of 64 bits.
    ``runs`` lists (start, length, period) of every stretch that has at least ``least`` words and
    ``exponent`` (four or more) times its smallest period, and that no neighbouring word
    prolongs; starts count words from 0, the order is by start, then period. ``collapsed`` holds
    the words, joined by one space, that lie in no run after the run's first period. ``order``
    may give, by a row's key and number of words, which word of the text stands at each place.

    A NULL or empty text, or one without words, has no runs and collapses to the empty text.
    Repeated rows come back as often. Rows with a NULL key are treated as others; ``order`` is not
    asked for them. Other columns are not read; an empty table gives no rows. A text is taken
    whole; a task needs some 300 bytes for each word of its longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 1 << 20):
            raw, word, start, end, bounds = _words(batch.column(1))
            count = np.diff(bounds)
            if order is not None:
                place = np.arange(len(word))
                for i, k in enumerate(batch.column(0).to_pylist()):
                    own = None if k is None or not count[i] else order(k, int(count[i]))
                    if own is not None:
                        place[bounds[i] : bounds[i + 1]] = bounds[i] + own
                word, start, end = word[place], start[place], end[place]
            of, first, length, period = find_runs(word, bounds, least, exponent)
            step = np.zeros(len(word) + 1, np.int64)
            np.add.at(step, bounds[of] + first + period, 1)
            np.add.at(step, bounds[of] + first + length, -1)
            kept = np.cumsum(step)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            found = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (first, length, period)],
                ["start", "length", "period"],
            )
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                    _joined(raw, start[kept], end[kept], left),
                ],
                ["key", "n_words", "runs", "collapsed"],
            )

    source = df.selectExpr(f"`{key}` AS key", f"`{text}` AS _text")
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(
        run,
        f"key {kind}, n_words bigint, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string",
    )
    return out.withColumnRenamed("key", key)
