"""Hard negatives by a vertical scan that bounds what unread dimensions can add.

The vectors of a block lie dimension by dimension. For an anchor the dimensions are read in
descending order of its components' size. The rest of an inner product lies between the sums of
the smallest and of the largest contributions that the block's minima and maxima allow. With
each step the bitmap of candidates shrinks to those whose interval still meets one of the
anchor's windows of scores and can be among the window's best; what is left when all
dimensions are read has its exact score.

Positives come from one scan with a window without ends over the rows of the anchor's label,
negatives from another one over the rows of other labels with one window per positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import vectors
from varloom.plans.scale import cut_lineage

DIMENSIONS = 8


def scan(
    columns: np.ndarray,
    extremes: tuple[np.ndarray, np.ndarray],
    query: np.ndarray,
    candidates: np.ndarray,
    windows: np.ndarray,
    k: int,
    slack: float = 0.0,
) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that may be among the k best of a window, and their inner products.

    ``columns`` is (dimensions, rows), ``extremes`` the minimum and maximum of each dimension,
    ``windows`` (lowest, highest) scores, ``slack`` a bound of rounding errors.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    most = np.maximum(query * extremes[0], query * extremes[1])[order]
    least = np.minimum(query * extremes[0], query * extremes[1])[order]
    # what the dimensions from each place on can add
    most = np.append(np.cumsum(most[::-1])[::-1], 0.0) + slack
    least = np.append(np.cumsum(least[::-1])[::-1], 0.0) - slack
    alive, sums = candidates, np.zeros(len(candidates))
    for start in range(0, len(query), DIMENSIONS):
        own = order[start : start + DIMENSIONS]
        part = columns[own] if len(alive) == columns.shape[1] else columns[np.ix_(own, alive)]
        sums = sums + query[own] @ part
        end = min(start + DIMENSIONS, len(query))
        keep = np.zeros(len(alive), bool)
        for low, high in windows:
            meets = (sums + most[end] >= low) & (sums + least[end] <= high)
            sure = sums[(sums + least[end] >= low) & (sums + most[end] <= high)] + least[end]
            if len(sure) > k:  # k candidates are in this window, so none below them is needed
                meets &= sums + most[end] >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= meets
        alive, sums = alive[keep], sums[keep]
    return alive, sums


class Windows:
    """The best rows by window for the anchors of a round."""

    def __init__(self, queries: pa.Table, k: int, same: bool):
        self.queries, self.k, self.same = queries, k, same
        self.by_length = vectors.by_length(queries)
        self.own = queries.column("id").to_pylist()
        self.label = queries.column("label").to_pylist()
        ends = [queries.column(c).to_pylist() for c in ("low", "high")]
        self.windows = [list(zip(*pair)) for pair in zip(*ends)]
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in self.windows]

    def add(self, block: vectors.Block) -> None:
        x, k = block.x, self.k
        rows, queries = self.by_length.get(x.shape[1], ((), x[:0]))
        columns = np.ascontiguousarray(x.T)
        extremes = columns.min(axis=1), columns.max(axis=1)
        fits = vectors.exact_in_doubles(x, queries)
        length = np.linalg.norm(x, axis=1).max()
        of_label = {s: np.flatnonzero((block.label == s) == self.same) for s in set(self.label)}
        for i, query in zip(rows, queries):
            now = [
                (best[-1][0] * -1 if len(best) == k else low, high)
                for (low, high), best in zip(self.windows[i], self.best[i])
            ]
            floats = np.array([(-np.inf if a is None else a, np.inf if b is None else b) for a, b in now], float)
            slack = 0.0 if fits else 1.0 + 1e-9 * float(np.linalg.norm(query) * length)
            floats += [-slack, slack]
            candidates = of_label[self.label[i]]
            alive, sums = scan(columns, extremes, query, candidates, floats, k + 1, slack)
            scores = sums.astype(np.int64).tolist() if fits else vectors.inner(x[alive], query)
            for j, (low, high) in enumerate(now):
                inside = [
                    n
                    for n, s in enumerate(scores)
                    if (low is None or s >= low) and (high is None or s <= high)
                ]
                self.best[i][j] = vectors.merge(
                    self.best[i][j], block.ids, alive[inside], [-scores[n] for n in inside], self.own[i], k
                )

    def found(self) -> pa.Table:
        flat = [
            (i, j, -score, row)
            for i, windows in enumerate(self.best)
            for j, best in enumerate(windows)
            for score, row in best
        ]
        take = pa.array([f[0] for f in flat], pa.int64())
        return pa.table(
            {
                "qid": self.queries.column("id").take(take),
                "qmark": self.queries.column("mark").take(take),
                "place": pa.array([f[1] for f in flat], pa.int32()),
                "id": pa.array([f[3] for f in flat], pa.int64()),
                "score": vectors.whole_scores([f[2] for f in flat]),
            }
        )


def _best(rows: DataFrame, asking: DataFrame, k: int, same: bool) -> DataFrame:
    return vectors.search(
        rows,
        asking,
        lambda queries: Windows(queries, k, same),
        "qid long, qmark long, place int, id long, score long",
        ["qid", "qmark", "place"],
        [F.desc("score"), F.col("id")],
        k,
    )


def hard_negatives(
    df: DataFrame,
    *,
    key: str,
    vector: str,
    label: str,
    asked: Column,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows
    picked by ``asked``, a condition on the column ``id``.

    Scores are inner products of floor(scale * x). An anchor's positives are its best other rows
    of the same label; for each of them the best rows of other labels are returned whose score s
    satisfies up * positive_score <= down * s <= down * positive_score, for ``share`` =
    (up, down). Higher scores come first, ties by smaller id; with fewer rows all are returned.
    An anchor without positives, or a positive without such negatives, gives no rows.

    Only vectors of equal length are compared. Rows with a NULL key or label take no part, nor do
    vectors that are NULL, empty, or hold NULL or non-finite components. Products are exact
    whatever their size; a score that is among a task's best and leaves 64 bits raises. Repeated
    rows count once; of an id with several vectors or labels, each asks and answers by itself, but
    never for its own id. Other columns are not read; an empty table gives no rows.
    """
    up, down = share
    points = vectors.points(
        df.where(F.col(label).isNotNull()), key, vector, vectors.whole(scale), label
    )
    points = cut_lineage(points)
    rows = vectors.stored(points, max(positives, negatives))
    anchors = points.where(asked).withColumn("mark", F.xxhash64("v", "label"))
    none = F.array(F.lit(None).cast("long"))
    near = _best(rows, anchors.select("*", none.alias("low"), none.alias("high")), positives, True)
    near = near.withColumn("place", F.col("rank") - 1).drop("rank")
    # 80 * positive <= 100 * s, in whole numbers that may pass 64 bits on the way
    bound = F.ceil(F.col("score").cast("decimal(20,0)") * up / down).cast("long")
    ends = F.sort_array(F.collect_list(F.struct("place", bound.alias("low"), F.col("score").alias("high"))))
    windows = near.groupBy("qid", "qmark").agg(ends.alias("w"))
    windows = windows.select(
        F.col("qid").alias("id"), F.col("qmark").alias("mark"), F.col("w.low"), F.col("w.high")
    )
    asking = cut_lineage(anchors.join(windows, ["id", "mark"]))
    far = _best(rows, asking, negatives, False)
    near = near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    return far.join(near, ["qid", "qmark", "place"]).select(
        F.col("qid").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
