"""Exact search equals brute force and SQL; approximate search reaches its recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import canonical, sql_tables
from varloom.llm import forest, topk, vectors
from varloom.llm.queries import ORACLES, QUERIES


def test_exact_query_equals_sql(spark, folder):
    df = QUERIES["op8_exact_topk"](spark, folder)
    cur = sql_tables(folder).execute(ORACLES["op8_exact_topk"])
    names = [c[0] for c in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_forest_recall_and_exact_scores(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in QUERIES["op9_forest"](spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, distance)) if ids[i] != q][:10]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        for _, i, s in own:
            assert s == distance[ids == i][0]
        hits += len({ids[i] for i in best} & {i for _, i, _ in own})
    assert hits / (10 * sum(ids % 100 == 0)) >= 0.9


def odd_rows():
    r = random.Random(9)
    common = [0.5, -0.25, 1.0]
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)]
    rows += [(i, common) for i in range(100, 160)] + [(100, common), (0, rows[0][1])]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [math.nan, 1.0, 1.0])]
    rows += [(204, [math.inf, 1.0, 1.0]), (None, common), (300, [1.0, 2.0]), (301, [0.0] * 3)]
    rows += [(5, [9.0, 9.0, 9.0]), (400, [3e5, 0.0, 1.0]), (401, [-3e5, 1.0, 1.0]), (402, [1e6, 1e6, 3e5])]
    return rows


def plain(rows, ask, measure, sign, usable=lambda v: True, k=10):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and usable(v)})
    out = []
    for i, v in good:
        if i % ask == 0:
            near = sorted((sign * measure(v, w), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, sign * s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [8192, 7])
def test_odd_rows_ties_and_repeats(spark, monkeypatch, size):
    """Also with many small blocks and rounds."""
    monkeypatch.setattr(vectors, "ROWS", size)
    monkeypatch.setattr(vectors, "ROUND", size * 40)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    ask = F.col("id") % 5 == 0

    def inner(v, w):
        return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(v, w))

    got = topk.exact_top_k(df, key="vec_id", vector="embedding", asked=ask).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, inner, -1)
    near = forest.nearest(df, key="vec_id", vector="embedding", asked=ask, share=99.0, leaf=4).collect()
    want = plain(rows, 5, lambda v, w: math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), 1, any)
    assert [r[:3] for r in sorted(map(tuple, near))] == [r[:3] for r in want]
    big = spark.createDataFrame([(0, [1e30]), (5, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.exact_top_k(big, key="vec_id", vector="embedding", asked=ask)
    for search in (topk.exact_top_k, forest.nearest):
        assert search(df.limit(0), key="vec_id", vector="embedding", asked=ask).count() == 0


def test_bounds_drop_candidates_but_none_of_the_best():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(3000, 64)) * np.geomspace(900, 1, 64))
    left = [np.sqrt((x[:, i:] ** 2).sum(axis=1)) for i in range(0, 64, topk.DIMENSIONS)]
    for query in x[:20]:
        alive, sums = topk.survivors(np.ascontiguousarray(x.T), query, left, 10)
        assert len(alive) < 1000
        assert set(np.argsort(-(x @ query), kind="stable")[:10]) <= set(alive)
        assert (sums == x[alive] @ query).all()
