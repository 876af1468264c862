"""Run registered queries against their SQL twins and report the differences.

``python -m checks.compare [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, names):
    """Rows with the columns in name order, sorted, with plain Python values."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v

    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark, con, folder: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    ours = canonical(df.collect(), df.columns)
    if name not in ORACLES:
        return None if ours else "no rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if not ours:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0][0]} against {bad[0][1]}"
    kinds = [(type(a), type(b)) for a, b in zip(ours[0], theirs[0]) if type(a) is not type(b)]
    return f"types {kinds}" if kinds else None


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_tables(folder)
    failed = 0
    for name in argv[1:] or list(QUERIES):
        start = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        spark.catalog.clearCache()
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
