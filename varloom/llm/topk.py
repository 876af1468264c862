"""Exact search for the highest inner products by branch and bound over columns.

The vectors of a block lie dimension by dimension. For a query, partial sums grow by one block
of dimensions at a time. What the other dimensions can still add is at most the product of the
remaining lengths; candidates that cannot reach the k-th best lower bound, or the k-th best
score of earlier blocks, are dropped, and only the survivors' columns are read on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import vectors
from varloom.plans.scale import cut_lineage

DIMENSIONS = 16


def survivors(
    columns: np.ndarray, query: np.ndarray, left: list[np.ndarray], k: int, floor: float = -np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that may be among the k best and reach ``floor``, and their inner
    products.

    ``columns`` is (dimensions, candidates); ``left[j]`` holds the candidates' lengths over the
    dimensions from block j on.
    """
    dims, n = columns.shape
    alive, sums = np.arange(n), np.zeros(n, columns.dtype)
    slack = 1.0 + 1e-9 * np.linalg.norm(query) * left[0]
    for j, start in enumerate(range(0, dims, DIMENSIONS)):
        end = start + DIMENSIONS
        part = columns[start:end] if len(alive) == n else columns[start:end, alive]
        sums = sums + query[start:end] @ part
        if end < dims and len(alive) > k:
            rest = np.linalg.norm(query[end:]) * left[j + 1][alive] + slack[alive]
            least = max(floor, np.partition(sums - rest, len(alive) - k)[len(alive) - k])
            keep = sums + rest >= least
            alive, sums = alive[keep], sums[keep]
    return alive, sums


class Best:
    """The highest inner products for the queries of a round."""

    def __init__(self, queries: pa.Table, k: int):
        self.queries, self.k = queries, k
        self.by_length = vectors.by_length(queries)
        self.own = queries.column("id").to_pylist()
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.own]

    def add(self, block: vectors.Block) -> None:
        x, k = block.x, self.k
        rows, queries = self.by_length.get(x.shape[1], ((), x[:0]))
        columns = np.ascontiguousarray(x.T)
        left = [np.linalg.norm(x[:, i:], axis=1) for i in range(0, x.shape[1], DIMENSIONS)]
        fits = vectors.exact_in_doubles(x, queries)
        for i, query in zip(rows, queries):
            best = self.best[i]
            floor = -best[-1][0] if len(best) == k else -np.inf
            alive, sums = survivors(columns, query, left, k + 1, float(floor))
            scores = sums.astype(np.int64).tolist() if fits else vectors.inner(x[alive], query)
            self.best[i] = vectors.merge(best, block.ids, alive, [-s for s in scores], self.own[i], k)

    def found(self) -> pa.Table:
        row = pa.array(np.repeat(np.arange(len(self.best)), [len(b) for b in self.best]), pa.int64())
        flat = [pair for best in self.best for pair in best]
        return pa.table(
            {
                "qid": self.queries.column("id").take(row),
                "qmark": self.queries.column("mark").take(row),
                "id": pa.array([i for _, i in flat], pa.int64()),
                "score": vectors.whole_scores([-s for s, _ in flat]),
            }
        )


def exact_top_k(
    df: DataFrame, *, key: str, vector: str, asked: Column, k: int = 10, scale: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row picked by ``asked``, a condition on the
    column ``id``, the k other rows with the highest inner product of floor(scale * x).

    Ties go to smaller ids; with fewer candidates all are returned. Only vectors of equal
    length are compared. Vectors that are NULL, empty, or hold NULL or non-finite components take
    no part, nor do rows with a NULL key. Products are exact whatever their size; a score that is
    among a task's best and leaves 64 bits raises. Repeated rows count once; of an id with
    several vectors, each asks and answers by itself, but never for its own id. Other columns are
    not read; an empty table gives no rows.
    """
    points = cut_lineage(vectors.points(df, key, vector, vectors.whole(scale)))
    asking = points.where(asked).withColumn("mark", F.xxhash64("v"))
    found = vectors.search(
        vectors.stored(points, k),
        asking,
        lambda queries: Best(queries, k),
        "qid long, qmark long, id long, score long",
        ["qid", "qmark"],
        [F.desc("score"), F.col("id")],
        k,
    )
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
