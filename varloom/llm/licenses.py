"""Licence texts found in documents by the Dice coefficient of word bigrams.

The passages of a text are its lines, its paragraphs and the whole. Letters are lower-cased
and everything but letters and digits parts words. With a bigrams in a passage and b in a
template, the coefficient is at most 2 * min(a, b) / (a + b), so only templates of a similar
size are compared, and of those only passages with enough bigrams that occur in any template.

Besides, windows of words are compared wherever they begin and however long they are, across
lines and paragraphs. The best windows begin and end with bigrams of the template. A window with
coefficient c holds at least c * b / (2 - c) of these within b * (2 - c) / c, so a running count
of them leaves few places to look at.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm.common import small_batches, text_buffers
from varloom.llm.shingles import LOWER, mix, runs

# fixed values: short notices and texts of common licences
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the"
        " License for the specific language governing permissions and limitations under the"
        " License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in"
        " all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\","
        " WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN"
        " NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
        " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
    ),
    "GPL-3.0 notice": (
        "This work is licensed under the GNU General Public License, version 3."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause clause": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met"
    ),
}

_PARTS = np.zeros(256, bool)
_PARTS[:128] = [not chr(b).isalnum() for b in range(128)]


def _bigrams(word: np.ndarray) -> np.ndarray:
    return mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(word[1:]))


def _template(text: str) -> np.ndarray:
    raw, off = text_buffers(pa.array([text]))
    return np.sort(_bigrams(runs(LOWER[raw], off, _PARTS)[0]))


def _dice(x: np.ndarray, y: np.ndarray) -> float:
    """The coefficient of two sorted lists of bigrams, repeated ones counted as often."""
    values, left = np.unique(x, return_counts=True)
    other, right = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, other, assume_unique=True, return_indices=True)
    return 2 * int(np.minimum(left[i], right[j]).sum()) / (len(x) + len(y))


def _passages(low: np.ndarray, start: int, end: int) -> list[tuple[int, int, int, int]]:
    """(first byte, end byte, first line, last line) of lines, paragraphs and the text."""
    own = low[start:end]
    breaks = np.flatnonzero(own == 10)
    begins = np.concatenate([[0], breaks + 1])
    ends = np.append(breaks, len(own))
    lines = [(int(b) + start, int(e) + start, i, i) for i, (b, e) in enumerate(zip(begins, ends))]
    out, first = list(lines), None
    for i in range(len(lines) + 1):
        blank = i == len(lines) or not own[lines[i][0] - start : lines[i][1] - start].size
        if blank and first is not None:
            if i - 1 > first:
                out.append((lines[first][0], lines[i - 1][1], first, i - 1))
            first = None
        elif not blank and first is None:
            first = i
    if len(lines) > 1:
        out.append((start, end, 0, len(lines) - 1))
    return out


def _windows(
    hits: np.ndarray, ends: np.ndarray, pair: np.ndarray, template: np.ndarray, least: float
) -> list[tuple[float, int, int]]:
    """(score, first, last bigram) of windows that match a template, by first bigram.

    ``hits`` are the places of the template's bigrams, ``ends`` where their texts end. For each
    place the best window that begins there counts, of equal ones the shortest.
    """
    b = len(template)
    longest = int(b * (2 - least) / least + 1e-9)
    until = np.searchsorted(hits, np.minimum(hits + longest, ends))
    full = until - np.arange(len(hits)) >= least * b / (2 - least) - 1e-9
    out = []
    values, caps = np.unique(template, return_counts=True)
    limit = dict(zip(values.tolist(), caps.tolist()))
    for i in np.flatnonzero(full):
        first, left, shared, best = int(hits[i]), dict(limit), 0, (0.0, 0, 0)
        for last in hits[i : until[i]].tolist():
            x = int(pair[last])
            if left[x]:
                left[x] -= 1
                shared += 1
                score = 2 * shared / (last - first + 1 + b)
                if score > best[0]:
                    best = (score, first, last)
        if best[0] >= least:
            out.append(best)
    return out


def _apart(windows: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Windows of one template that share no word: the best first, of equal ones the earliest."""
    begins, taken = [], {}
    for score, first, last in sorted(windows, key=lambda x: (-x[0], x[1])):
        at = bisect(begins, last + 1)  # bigrams first to last have words first to last + 1
        if at and taken[begins[at - 1]][2] + 1 >= first:
            continue
        begins.insert(at, first)
        taken[first] = (score, first, last)
    return [taken[x] for x in begins]


def _outermost(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """(first, last bigram, score, template) without those inside of others; of equal spans the
    best stays, then the first by template."""
    out, reach = [], -1
    for x in sorted(spans, key=lambda x: (x[0], -x[1], -x[2], x[3])):
        if x[1] > reach:
            out.append(x)
            reach = x[1]
    return out


def scan(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    least: float = 0.9,
) -> DataFrame:
    """(key, license, score, first_line, last_line): passages and windows that match a template.

    A passage matches the template with the highest coefficient, of equal ones the first by
    name, if it is at least ``least``. A passage that is both a line and more is reported once.
    Windows of one template share no word with each other or with a passage reported for it, the
    best first; a window inside a reported passage or a longer window is not reported.
    Lines count from 0. Templates and passages of fewer than two words match nothing.

    NULL and empty texts have no passages; repeated rows are reported again; other columns are
    not read; an empty table gives no rows. Texts are read whole.
    """
    if not 0 < least <= 1:
        raise ValueError("the least coefficient must be above 0 and at most 1")
    known = sorted((name, x) for name, x in ((n, _template(t)) for n, t in templates.items()) if len(x))
    sizes = np.array([len(x) for _, x in known], float)
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for _, x in known]]))
    member = [np.isin(every, x) for _, x in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 4 << 20):
            raw, off = text_buffers(batch.column(1))
            low = LOWER[raw]
            word, starts = runs(low, off, _PARTS)
            pair = _bigrams(word)
            at = np.searchsorted(every, pair)
            at[at == len(every)] = 0
            common = np.concatenate([[0], np.cumsum(every[at] == pair)]) if len(every) else None
            found, windows = [], [[] for _ in range(batch.num_rows)]
            edge = np.searchsorted(starts, off)
            inside = np.flatnonzero(every[at] == pair) if len(every) else np.zeros(0, np.int64)
            owner = np.searchsorted(edge, inside, side="right") - 1
            whole = inside + 1 < edge[owner + 1]  # not from one text to the next
            inside, owner = inside[whole], owner[whole]
            for k, (_, template) in enumerate(known):
                own = member[k][at[inside]]
                hits, ends = inside[own], edge[owner[own] + 1] - 1
                for score, first, last in _apart(_windows(hits, ends, pair, template, least)):
                    windows[np.searchsorted(edge, first, side="right") - 1].append((first, last, score, k))
            for i in range(batch.num_rows):
                a, b = np.searchsorted(starts, off[i : i + 2])
                # no passage of a text has more bigrams of templates than the text
                if common is None or b - a < 2 or common[b - 1] == common[a]:
                    continue
                seen, reported = set(), []
                for start, end, first, last in _passages(low, off[i], off[i + 1]):
                    s, e = np.searchsorted(starts, (start, end))
                    n = e - 1 - s
                    if n < 1 or (s, e) in seen or 2 * (common[e - 1] - common[s]) < least * (n + sizes.min()):
                        continue
                    seen.add((s, e))
                    fits = 2 * np.minimum(n, sizes) >= least * (n + sizes)
                    own = np.sort(pair[s : e - 1])
                    scores = [(_dice(own, known[k][1]), -k) for k in np.flatnonzero(fits)]
                    score, k = max(scores, default=(0.0, 0))
                    if score >= least:
                        found.append((i, known[-k][0], score, first, last))
                        reported.append((s, e - 2, -k))
                rest = [
                    w
                    for w in windows[i]
                    if not any(
                        w[3] == k and w[0] <= end + 1 and start <= w[1] + 1 or start <= w[0] and w[1] <= end
                        for start, end, k in reported
                    )
                ]
                for first, last, score, k in _outermost(rest):
                    lines = [int((low[off[i] : starts[x]] == 10).sum()) for x in (first, last + 1)]
                    found.append((i, known[k][0], score, *lines))
            rows, *rest = zip(*found) if found else ((), (), (), (), ())
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *[pa.array(x, kind) for x, kind in zip(rest, kinds)],
                ],
                ["key", "license", "score", "first_line", "last_line"],
            )

    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS _text")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(
        run, f"key {kind}, license string, score double, first_line bigint, last_line bigint"
    )
    return out.withColumnRenamed("key", key)
