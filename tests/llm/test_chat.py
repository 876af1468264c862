"""Maximal conversations equal the SQL and a plain Python version."""

import random

from checks.compare import canonical, sql_tables
from varloom.llm import chat
from varloom.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, folder):
    df = QUERIES["op10_chat"](spark, folder)
    cur = sql_tables(folder).execute(ORACLES["op10_chat"])
    names = [c[0] for c in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def plain(rows):
    talks = {}
    for c, t, role, text in set(rows):
        talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    talks = {c: tuple(x[2:] for x in sorted(v)) for c, v in talks.items()}
    best = {}
    for c in sorted(talks, key=lambda c: (c is not None, c or 0)):
        best.setdefault(talks[c], c)
    inner = {t[:n] for t in best for n in range(1, len(t))}
    return sorted(
        ((c, len(t), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)) for t, c in best.items() if t not in inner),
        key=str,
    )


def test_snapshots_nulls_ties_and_repeats(spark):
    r = random.Random(4)
    rows = []
    for c in range(60):
        turns = [("user" if n % 2 == 0 else "bot", r.choice("ab")) for n in range(r.randint(1, 6))]
        rows += [(c, 2 * n + c % 3, *x) for n, x in enumerate(turns)]
    rows += rows[:20] + [(70, None, None, None), (71, None, "", ""), (None, 0, "user", "z"), (72, 1, "x", "b"), (72, 1, "x", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS c")
    got = sorted(((x.conv_id, x.n_turns, x.rendered) for x in chat.render(df).collect()), key=str)
    assert got == plain(rows)
    assert chat.render(df.limit(0)).count() == 0
