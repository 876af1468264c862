"""Budgets and prefixes equal a plain Python version and the SQL."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from checks.compare import canonical, sql_tables
from varloom.llm import mixing
from varloom.llm.queries import ORACLES, QUERIES


def share_out(amount, children):
    """{name: part} by weight under caps: raise all alike, fix the full ones, repeat."""
    got, todo = {n: 0.0 for n in children}, {n for n, (w, c) in children.items() if w > 0}
    while todo:
        left = amount - sum(got.values())
        weight = sum(children[n][0] for n in todo)
        full = {n for n in todo if children[n][1] <= children[n][0] * left / weight + 1e-9}
        if not full:
            return got | {n: children[n][0] * left / weight for n in todo}
        got |= {n: children[n][1] for n in full}
        todo -= full
    return got


def expected(rows, weights, share, epochs, seed):
    rows = [(k, *[x or "(none)" for x in p], max(t or 0, 0)) for k, *p, t in rows]
    depth = len(weights)
    cap = {}
    for row in rows:
        cap[row[1:-1]] = cap.get(row[1:-1], 0) + row[-1] * epochs
    caps = {depth: cap}
    weight = lambda d, p: weights[d - 1].get(p[-1], 1.0)
    for d in range(depth, 0, -1):
        caps[d] = {p: c if weight(d, p) > 0 else 0 for p, c in caps[d].items()}
        caps[d - 1] = {}
        for p, c in caps[d].items():
            caps[d - 1][p[:-1]] = caps[d - 1].get(p[:-1], 0) + c
    granted = {(): float(int(sum(r[-1] for r in rows) * share))}
    for d in range(1, depth + 1):
        now = {}
        for parent, amount in granted.items():
            kids = {p: (weight(d, p), c) for p, c in caps[d].items() if p[:-1] == parent}
            now |= share_out(amount, kids)
        granted = now
    out = []
    for leaf, amount in granted.items():
        own = [r for r in rows if r[1:-1] == leaf]
        size = max(sum(r[-1] for r in own), 1)
        whole, rest = divmod(math.floor(amount + 1e-6), size)
        place = lambda r: hashlib.md5(f"{seed}|{whole}|{'' if r[0] is None else r[0]}".encode()).hexdigest()
        until = 0
        for r in sorted(own, key=place):
            until += r[-1]
            out.append((r[0], whole + (until <= rest)))
    return sorted(out, key=str)


def test_query_equals_sql(spark, folder):
    df = QUERIES["op4_mixing"](spark, folder)
    cur = sql_tables(folder).execute(ORACLES["op4_mixing"])
    names = [c[0] for c in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_shortages_go_to_siblings_first(spark):
    rows = [(1, "a", "x", 10), (2, "a", "y", 1000), (3, "b", "x", 1000), (4, "b", "y", 1000)]
    df = spark.createDataFrame(rows, "k long, d string, s string, available long")
    leaves = df.select("d", "s", "available")
    got = mixing.allocate(leaves, ["d", "s"], [{}, {}], 800, 1).collect()
    assert {(r.d, r.s): r.granted for r in got} == {
        ("a", "x"): 10,
        ("a", "y"): 390,
        ("b", "x"): 200,
        ("b", "y"): 200,
    }


def test_random_trees_nulls_and_repeats_equal_plain_python(spark):
    r = random.Random(2)
    names = [None, "p", "q", "r"]
    rows = [
        (i // 2 if i % 9 == 0 else i, r.choice(names), r.choice(names), r.choice([None, 0, -3, 5, 40, 900]))
        for i in range(300)
    ] + [(None, "p", "q", 7)]
    weights = ({"p": 3.0, "q": 0.0}, {"r": 5.0})
    df = spark.createDataFrame(rows, "k long, a string, b string, t long").selectExpr("*", "1 AS copies", "2 AS available")
    for share in (0.3, 2.5, 9.0):
        out = mixing.mix(df, key="k", tokens="t", path=["a", "b"], weights=weights, budget_share=share, max_epochs=3, seed=4)
        got = sorted(((x.k, x.copies) for x in out.collect()), key=str)
        assert got == expected(rows, weights, share, 3, 4)
    none = mixing.mix(df.limit(0), key="k", tokens="t", path=["a"], weights=({},), budget_share=1.0)
    assert none.count() == 0


def test_path_columns_may_have_any_names(spark):
    names = ["parent", "cap", "w", "left", "rest", "full", "first", "granted", "available"]
    rows = [(i, *[f"n{(i >> b) % 2}" for b in range(9)], 10 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} string" for n in names) + ", t long")
    out = mixing.mix(df, key="k", tokens="t", path=names, weights=({},) * 9, budget_share=0.5, seed=1)
    assert out.columns == ["k", *names, "t", "copies"] and out.count() == 40
    plain = df.select("k", *[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], "t")
    same = mixing.mix(plain, key="k", tokens="t", path=[f"c{i}" for i in range(9)], weights=({},) * 9, budget_share=0.5, seed=1)
    assert {r.k: r.copies for r in out.collect()} == {r.k: r.copies for r in same.collect()}
