"""Mined negatives equal SQL and a scan of all pairs; the scan drops none of a window's best."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import canonical, sql_tables
from varloom.llm import negatives, vectors
from varloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    df = QUERIES["op11_negatives"](spark, folder)
    cur = sql_tables(folder).execute(ORACLES["op11_negatives"])
    names = [c[0] for c in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)
    assert df.count() > 0


def mined(rows, ask, k=5):
    good = sorted(
        {
            (i, tuple(math.floor(256 * x) for x in v), s)
            for i, v, s in rows
            if i is not None and s is not None and v and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    out = []
    for i, v, s in good:
        if i % ask:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), j, t) for j, w, t in good if j != i and len(w) == len(v)
        ]
        for p, j, _ in sorted(x for x in scored if x[2] == s)[:k]:
            near = [(n, m) for n, m, t in sorted(scored) if t != s and -80 * p <= -100 * n <= -100 * p]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(near[:k])]
    return sorted(out)


def odd_rows():
    r = random.Random(4)
    rows = [(i, [r.gauss(1, 1) for _ in range(5)], r.randrange(3)) for i in range(150)]
    same = [0.5, -0.25, 1.0, 2.0, 0.0]
    rows += [(i, same, i % 2) for i in range(200, 260)] + [(200, same, 0), (0, rows[0][1], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 1.0, 1.0, 1.0], 1), (303, [math.nan] * 5, 1)]
    rows += [(304, same, None), (None, same, 1), (305, [1.0, 2.0], 1), (310, [2.0, 1.0], 0)]
    rows += [(320, [3e5, 1e5, 0.0, 7.0, 1.0], 0), (321, [2.9e5, 1e5, 1.0, 7.0, 1.0], 1), (325, [0.0] * 5, 2)]
    return rows


@pytest.mark.parametrize("size", [8192, 7])
def test_odd_rows_ties_and_repeats(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "ROWS", size)
    monkeypatch.setattr(vectors, "ROUND", size * 40)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("score", F.lit("x")).withColumn("place", F.lit(1))
    args = dict(key="vec_id", vector="embedding", label="label", asked=F.col("id") % 5 == 0)
    got = negatives.hard_negatives(df, **args).collect()
    assert sorted(map(tuple, got)) == mined(rows, 5)
    assert negatives.hard_negatives(df.limit(0), **args).count() == 0
    big = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="leaves 64 bits"):
        negatives.hard_negatives(big, **args)


def test_scan_drops_rows_but_none_of_the_best():
    r = np.random.default_rng(8)
    x = np.floor(r.normal(size=(4000, 64)) * np.geomspace(700, 1, 64))
    columns = np.ascontiguousarray(x.T)
    extremes = columns.min(axis=1), columns.max(axis=1)
    for query in x[:15]:
        scores = x @ query
        top = np.sort(scores)[-50]
        windows = np.array([(top * 0.8, top), (-np.inf, scores.min() + 5)])
        alive, sums = negatives.scan(columns, extremes, query, np.arange(4000), windows, 5)
        assert (sums == scores[alive]).all() and len(alive) < 400
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            assert set(inside[np.argsort(-scores[inside], kind="stable")][:5]) <= set(alive)
