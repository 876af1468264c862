"""Runs equal those found by trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.brute import WORD
from varloom.llm import periods
from varloom.llm.queries import QUERIES


def all_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def stretched(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_runs"](spark, folder).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = stretched(doc_id, WORD.findall(text or ""))
        runs = all_runs(words) if len(words) < 2500 else None
        r = got[doc_id]
        if runs is None:
            continue
        some += bool(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some > 5


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts_equal_brute_force(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        text = []
        while len(text) < r.choice([0, 5, 30, 120]):
            unit = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21]))]
            if r.random() < 0.3:
                unit = unit * r.randrange(1, 6) + [7]
            text += unit * r.choice([1, 1, 3, 4, 5, 9]) + unit[: r.randrange(len(unit) + 1)]
            text += [r.randrange(9) for _ in range(r.choice([0, 1, 4]))]
        texts.append(text)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = np.array([w for t in texts for w in t], np.uint64)
    of, start, length, period = periods.find_runs(words, bounds)
    got = [[] for _ in texts]
    for i, *run in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[i].append(tuple(run))
    for text, runs in zip(texts, got):
        assert runs == all_runs(text), text


def test_successors_equal_a_scan():
    r = np.random.default_rng(1)
    values = r.permutation(97)
    tree = periods.Successors(values)
    low = r.integers(0, 97, 300)
    high = np.minimum(97, low + r.integers(0, 40, 300))
    bound = r.integers(0, 200, 300)
    want = [min([v for v in values[a:b] if v >= c], default=-1) for a, b, c in zip(low, high, bound)]
    assert tree.at_least(low, high, bound).tolist() == want


def test_nulls_long_texts_repeats_and_clashing_names(spark):
    long = "a b " * 60_000
    rows = [
        (1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "x x x x x", 0), (5, "X x\tx x\nx x  x", 0),
        (5, "X x\tx x\nx x  x", 0), (None, "é é é é é é ü", 0), (6, long, 0),
        (7, " ".join(str(i) for i in range(50_000)), 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = periods.collapse_runs(df, key="doc_id")
    got = sorted(
        (r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed if r.n_words < 99 else "")
        for r in out.collect()
    )
    assert got == [
        (0, 7, [(0, 6, 1)], "é ü"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 5, [], "x x x x x"),
        (5, 7, [(1, 6, 1)], "X x"),
        (5, 7, [(1, 6, 1)], "X x"),
        (6, 120_000, [(0, 120_000, 2)], ""),
        (7, 50_000, [], ""),
    ]
    assert periods.collapse_runs(df.limit(0), key="doc_id").count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(9, np.uint64), np.array([0, 9]), exponent=2)
