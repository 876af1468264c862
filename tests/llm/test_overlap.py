"""Jaccard classes equal those found by comparing all pairs; the list search equals set counts."""

import random

import numpy as np
import pytest

from tests.llm import brute
from varloom.llm import overlap
from varloom.llm.queries import QUERIES


def as_found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def classes(rows):
    sets = {k: brute.shingle_set(t, 4) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def edited(r, base, vocabulary, n):
    words = list(base)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(vocabulary)
    return words


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op12_jaccard"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes(docs)


@pytest.mark.parametrize("block", [4 << 20, 40_000])
def test_groups_of_edited_copies_equal_brute_force(spark, monkeypatch, block):
    """Also with blocks of five records, so that groups lie in many blocks."""
    for name in ("BLOCK", "ASKING"):
        monkeypatch.setattr(overlap, name, block)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([9, 40, 150]))]
        if r.random() < 0.5:
            base = passage + base
        for _ in range(r.choice([2, 6, 25])):
            words = edited(r, base, vocabulary, r.randint(0, 1 + len(base) // 30))
            rows.append((len(rows) * 7 % 2003, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_found(overlap.jaccard_classes(df, key="doc_id")) == classes(rows)


def test_one_passage_in_all_texts_links_none(spark):
    r = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(9999)}" for _ in range(60)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in overlap.jaccard_classes(df, key="doc_id").collect()} == set(range(300))


def test_nulls_short_and_long_texts_repeats_and_clashing_names(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (5, None, 1, 1),
        (6, " \t ", 1, 1),
        (7, "One two three", 2, 1),
        (3, "one TWO  three", 2, 1),
        (8, "one two", 3, 1),
        (4, "a b c d e", 3, 1),
        (8, "one two", 3, 1),
        (4, "one two three", 3, 1),
        (None, "one two three", 4, 1),
        (20, long, 1, 1),
        (21, long + " end", 1, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, cid int, tokens int")
    out = overlap.jaccard_classes(df, key="doc_id")
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out.collect())
    assert got == [
        (0, 1, 0), (3, 1, 3), (4, 1, 3), (4, 2, 4), (5, 0, 5), (6, 0, 6), (7, 1, 3), (8, 1, 8),
        (8, 1, 8), (20, 29997, 20), (21, 29998, 20),
    ]
    renamed = df.withColumnRenamed("doc_id", "n").limit(0)
    assert overlap.jaccard_classes(renamed, key="n").count() == 0


def test_list_search_equals_set_counts():
    r = np.random.default_rng(2)
    for _ in range(60):
        pool = r.integers(0, 1 << 62, r.integers(5, 120), dtype=np.uint64)
        sets = [
            np.unique(r.choice(pool, r.integers(1, len(pool) + 1))) for _ in range(r.integers(1, 30))
        ]
        own = np.unique(r.choice(pool, r.integers(1, len(pool) + 1)))
        least = r.integers(0, max(2, len(own)), len(sets))
        rows, shared = overlap.Lists(sets).search(own, least)
        want = {
            i: n for i, s in enumerate(sets)
            if least[i] and (n := len(np.intersect1d(own, s))) >= least[i]
        }
        assert dict(zip(rows.tolist(), shared.tolist())) == want


def test_sketches_differ_in_no_more_places_than_sets():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 50, 300, 900, 5000)]
    sets += [np.unique(np.concatenate([x[: len(x) - len(x) // 20], r.integers(0, 1 << 63, 7, dtype=np.uint64)])) for x in sets]
    size = np.array([len(x) for x in sets])
    rows = overlap._sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    words = [np.frombuffer(x.as_py(), np.uint64) for x in rows]
    assert [len(x) for x in words] == (overlap._buckets(size) // 64).tolist()
    for a, x in zip(sets, words):
        for b, y in zip(sets, words):
            m = min(len(x), len(y))
            folded = [np.bitwise_xor.reduce(z.reshape(-1, m), axis=0) for z in (x, y)]
            apart = np.bitwise_count(folded[0] ^ folded[1]).sum()
            assert apart <= len(np.setxor1d(a, b))
    # a set and an edited copy are near, others are told apart
    most = int((size[4] + size[10]) * 15 / 185)  # of two sets that are alike
    assert np.bitwise_count(words[4] ^ words[10]).sum() <= most < np.bitwise_count(words[4] ^ words[4][::-1]).sum()


def test_sets_that_only_share_lists_move_no_text(spark, monkeypatch):
    """Texts of common sentences in other orders share many lists, and none is like another."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    sentences = [" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(60)]
    rows = [(i, " ".join(r.sample(sentences, 25))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " one more") for i in range(4)]
    searched, search = [], overlap._search

    def seen(units, *args):
        searched.append({x.cid for x in units.select("cid").collect()})
        return search(units, *args)

    monkeypatch.setattr(overlap, "_search", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_found(overlap.jaccard_classes(df, key="doc_id")) == classes(rows)
    assert len(searched) == 2 and max(map(len, searched)) <= 12
