"""Registry of checked queries: the Spark form and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin where SQL can express it."""

    def add(fn):
        def run(spark, sf_dir):
            return fn(Tables(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def t_two_sided(t: str, df: str) -> str:
    """SQL for the two-sided tail of Student's t with whole degrees of freedom, as the finite
    series of sines and cosines."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = f"sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({th}), 2 * k + 1)"
    even = f"exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({th}), 2 * k)"

    def series(n: str, term: str) -> str:
        return f"coalesce(list_sum(list_transform(range({n}), lambda k: {term})), 0)"

    return f"""(1 - CASE WHEN ({df}) % 2 = 1
      THEN 2 / pi() * ({th} + sin({th}) * {series(f"(({df}) - 1) // 2", odd)})
      ELSE sin({th}) * {series(f"({df}) // 2", even)} END)"""


def solved_sql(a, b) -> list[str]:
    """The solution of two or three equations by determinants; ``a`` is symmetric."""

    def det(m):
        if len(m) == 2:
            return f"(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"
        parts = []
        for j, sign in enumerate("+-+"):
            rest = [[m[i][c] for c in range(3) if c != j] for i in (1, 2)]
            parts.append(f"{sign} ({m[0][j]}) * {det(rest)}")
        return "(" + " ".join(parts) + ")"

    whole = det(a)
    return [
        f"({det([[b[i] if c == j else a[i][c] for c in range(len(a))] for i in range(len(a))])} / {whole})"
        for j in range(len(a))
    ]
