"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are grown on a bounded sample: each node halves its sample across the line between
two random members. Every vector is then indexed: it falls into one leaf of each tree. A query
walks all trees at once from one priority queue, ordered by how far on the wrong side of a
split the query lies, until the leaves seen hold a given share of the sample. The index is cut
into blocks by row, each with lists of its rows by leaf; only the lists of the leaves seen are
read, their rows are ranked by exact distances, and the blocks' best are merged.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import vectors
from varloom.plans.scale import cut_lineage

SAMPLE, TREES, LEAF, SHARE = 16_384, 12, 64, 0.9


@dataclass
class Tree:
    """Nodes in order of growth; a leaf has no children and its share of the sample."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        inner = self.left[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            above = np.einsum("ij,ij->i", x[rows], self.normal[node]) > self.offset[node]
            at[rows] = np.where(above, self.right[node], self.left[node])
            inner = self.left[at] >= 0
        return at


def grow(sample: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    """One tree over a sample; members that no split parts stay together in a leaf."""
    normal, offset, left, right, share = [], [], [], [], []
    todo = [(np.arange(len(sample)), -1, False)]
    while todo:
        own, parent, above = todo.pop()
        me = len(normal)
        if parent >= 0:
            (right if above else left)[parent] = me
        normal.append(np.zeros(sample.shape[1]))
        offset.append(0.0)
        left.append(-1)
        right.append(-1)
        share.append(len(own) / max(len(sample), 1))
        if len(own) <= leaf:
            continue
        a, b = random.choice(own, 2, replace=False)
        line = sample[a] - sample[b]
        size = np.linalg.norm(line)
        if size == 0:
            continue
        place = sample[own] @ (line / size)
        middle = np.median(place)
        low, high = own[place <= middle], own[place > middle]
        if len(low) and len(high):
            normal[me], offset[me] = line / size, middle
            todo += [(low, me, False), (high, me, True)]
    arrays = (np.array(x) for x in (left, right, share))
    return Tree(np.array(normal), np.array(offset), *arrays)


def visit(trees: list[Tree], query: np.ndarray, share: float) -> list[list[int]]:
    """The leaves of each tree to look into."""
    side = [t.normal @ query - t.offset for t in trees]
    queue = [(0.0, i, 0) for i in range(len(trees))]
    seen, out = 0.0, [[] for _ in trees]
    while queue and seen < share:
        margin, i, node = heapq.heappop(queue)
        tree = trees[i]
        while tree.left[node] >= 0:
            far, d = tree.left[node], side[i][node]
            if d <= 0:
                far, node = tree.right[node], far
            else:
                node = tree.right[node]
            heapq.heappush(queue, (max(margin, abs(d)), i, int(far)))
        out[i].append(int(node))
        seen += tree.share[node]
    return out


class Near:
    """The nearest rows for the queries of a round."""

    def __init__(self, queries: pa.Table, trees: list[Tree], dim: int, k: int, share: float):
        self.queries, self.trees, self.dim, self.k = queries, trees, dim, k
        self.by_length = vectors.by_length(queries)
        self.own = queries.column("id").to_pylist()
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.own]
        rows, asked = self.by_length.get(dim, ((), ()))
        self.leaves = {i: visit(trees, q, share) for i, q in zip(rows, asked)}

    def add(self, block: vectors.Block) -> None:
        x, k = block.x, self.k
        rows, queries = self.by_length.get(x.shape[1], ((), x[:0]))
        if not len(rows):
            return
        indexed = x.shape[1] == self.dim
        lists = [self._lists(tree, x) for tree in self.trees] if indexed else []
        square = np.einsum("ij,ij->i", x, x)
        for i, q in zip(rows, queries):
            near = np.arange(len(x))
            if indexed:
                hit = np.zeros(len(x), bool)
                for (order, starts), leaves in zip(lists, self.leaves[i]):
                    for leaf in leaves:
                        hit[order[starts[leaf] : starts[leaf + 1]]] = True
                near = np.flatnonzero(hit)
            if not len(near):
                continue
            # squared distances up to rounding, then the exact ones of those that can matter
            best, own = self.best[i], float(q @ q)
            inner = (x @ q)[near] if 4 * len(near) > len(x) else x[near] @ q
            rough = square[near] - 2 * inner + own
            slack = 1e-9 * (square[near] + own)
            edge = best[-1][0] ** 2 * (1 + 1e-9) if len(best) == k else np.inf
            if len(near) > k:
                edge = min(edge, np.partition(rough + slack, k)[k])
            near = near[rough - slack <= edge]
            distance = np.sqrt(((x[near] - q) ** 2).sum(axis=1)).tolist()
            self.best[i] = vectors.merge(best, block.ids, near, distance, self.own[i], k)

    @staticmethod
    def _lists(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows in order of their leaves, and where each leaf begins."""
        leaf = tree.leaves(x)
        order = np.argsort(leaf, kind="stable")
        return order, np.searchsorted(leaf[order], np.arange(len(tree.left) + 1))

    def found(self) -> pa.Table:
        row = pa.array(np.repeat(np.arange(len(self.best)), [len(b) for b in self.best]), pa.int64())
        flat = [pair for best in self.best for pair in best]
        return pa.table(
            {
                "qid": self.queries.column("id").take(row),
                "qmark": self.queries.column("mark").take(row),
                "id": pa.array([i for _, i in flat], pa.int64()),
                "score": pa.array([s for s, _ in flat], pa.float64()),
            }
        )


def nearest(
    df: DataFrame,
    *,
    key: str,
    vector: str,
    asked: Column,
    k: int = 10,
    trees: int = TREES,
    leaf: int = LEAF,
    share: float = SHARE,
    sample: int = SAMPLE,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row picked by ``asked``, a condition on the
    column ``id``, the k nearest other rows found, by Euclidean distance.

    The trees are grown on at most ``sample`` different vectors of the most common length, the
    first in an order by hash; all rows are indexed. ``share`` is how much of the sample the
    visited leaves of all trees hold together; 1.0 or more looks into more than half of
    the rows. Vectors of another length are compared with all of their length. The trees go to
    all tasks; they hold some trees * sample / leaf * 3 vectors, whatever the table's size.

    Ties go to smaller ids. Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components take no part, nor do rows with a NULL key. Repeated rows count once; of an id
    with several vectors, each asks and answers by itself, but never for its own id. Other
    columns are not read; an empty table gives no rows.
    """
    points = cut_lineage(
        vectors.points(df, key, vector, lambda x: x.astype("<f8") if x.any() else None)
    )
    spark = df.sparkSession
    dims = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 0
    chosen = (
        points.where(F.col("dim") == dim)
        .select("v", F.xxhash64("v", F.lit(seed)).alias("h"))
        .distinct()
        .orderBy("h", "v")
        .limit(sample)
        .collect()
    )
    grown = np.frombuffer(b"".join(r.v for r in chosen), "<f8").reshape(len(chosen), dim)
    random = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([grow(grown, leaf, random) for _ in range(trees)])

    asking = points.where(asked).withColumn("mark", F.xxhash64("v"))
    found = vectors.search(
        vectors.stored(points, k),
        asking,
        lambda queries: Near(queries, forest.value, dim, k, share),
        "qid long, qmark long, id long, score double",
        ["qid", "qmark"],
        [F.asc("score"), F.col("id")],
        k,
    )
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
