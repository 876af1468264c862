"""Near-duplicate classes equal those found by comparing all pairs."""

import random

import pytest

from tests.llm import brute
from varloom.llm import minhash
from varloom.llm.components import components
from varloom.llm.queries import QUERIES


def as_found(df, key="doc_id"):
    return {r[key]: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_minhash"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_groups_of_edited_copies_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120]))]
        for _ in range(r.choice([2, 5, 20])):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_found(minhash.near_duplicates(df, key="doc_id")) == brute.near_duplicates(rows)


def test_nulls_short_texts_repeats_and_clashing_names(spark):
    rows = [
        (5, None, 1),
        (6, "  \n", 1),
        (7, "One two", 2),
        (3, "one TWO", 2),
        (8, "one two three", 3),
        (9, "É é", 3),
        (10, "é é", 3),
        (8, "one two three", 3),
        (None, "one two", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    out = minhash.near_duplicates(df, key="doc_id")
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept)
        for r in out.collect()
    )
    assert got == [
        (False, 3, 1, 3, True),
        (False, 5, 0, 5, True),
        (False, 6, 0, 6, True),
        (False, 7, 1, 3, False),
        (False, 8, 1, 8, True),
        (False, 8, 1, 8, True),
        (False, 9, 1, 9, True),
        (False, 10, 1, 10, True),
        (True, 0, 1, 0, True),
    ]
    assert minhash.near_duplicates(df.limit(0), key="doc_id").count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_equal_union_find(spark, shape):
    r = random.Random(1)
    if shape == "path":
        links = [(i, i + 1) for i in range(60)]
    elif shape == "star":
        links = [(99, i) for i in range(40)] + [(200, 201), (7, 7), (201, 200)]
    else:
        links = [(r.randrange(80), r.randrange(80)) for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in list(root)}
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    assert {x.id: x.component for x in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0
