"""Searching vectors in blocks: what exact and approximate search and mining share.

Equal vectors are stored once with their smallest ids, as many as a result can need. The
stored rows stay where they are: queries go to all tasks in rounds of bounded size, and each
task keeps the best of its own rows for every query of the round. Only these are shuffled, so
what moves does not grow with queries times rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.llm.common import prepare
from varloom.plans.scale import checkpoint_folder, cut_lineage

# Rows and bytes of a block of stored vectors, and bytes of the queries of a round.
ROWS, BLOCK, ROUND = 8192, 16 << 20, 8 << 20


@dataclass
class Block:
    """Stored vectors of one length: the vectors as rows, the ids and the label of each."""

    x: np.ndarray
    ids: list[list[int]]
    label: np.ndarray


class Searcher(Protocol):
    """What a task does with the queries of a round."""

    def add(self, block: Block) -> None: ...

    def found(self) -> pa.Table: ...


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite numbers, all their numbers, and the row bounds."""
    column = column.cast(pa.large_list(pa.float64()))
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return (sizes > 0) & (bad[bounds[1:]] == bad[bounds[:-1]]), values, bounds


def whole(scale: int) -> Callable[[np.ndarray], np.ndarray]:
    """floor(scale * x) as doubles, which hold such whole numbers exactly."""

    def change(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.floor(scale * x) + 0.0
        if not np.isfinite(out).all():
            raise ValueError("a scaled component leaves the range of doubles")
        return out

    return change


def points(
    df: DataFrame,
    key: str,
    vector: str,
    change: Callable[[np.ndarray], np.ndarray | None],
    label: str | None = None,
) -> DataFrame:
    """(id, dim, v, label): vectors as little-endian doubles, after ``change``, which gives
    None for a vector that takes no part. NULL ids, and NULL or non-finite components, take
    no part either. A row that repeats another one counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            good, values, bounds = lists(batch.column(1))
            rows, made = [], []
            for i in np.flatnonzero(good):
                own = change(values[bounds[i] : bounds[i + 1]])
                if own is not None:
                    rows.append(i)
                    made.append(own.astype("<f8").tobytes())
            ids, marks = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 2))
            dims = pa.array([len(x) // 8 for x in made], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, dims, pa.array(made, pa.binary()), marks], ["id", "dim", "v", "label"]
            )

    mark = F.lit("") if label is None else F.col(label).cast("string")
    source = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), mark.alias("label")
    )
    return source.mapInArrow(run, "id long, dim int, v binary, label string").distinct()


def stored(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, v, label, ids): different vectors with their k + 1 smallest ids, written in about
    as many parts as the cluster has cores or blocks are filled."""
    order = W.partitionBy("dim", "v", "label").orderBy("id")
    few = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    rows = few.groupBy("dim", "v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rows = cut_lineage(rows)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, math.ceil(rows.count() / ROWS)))
    if rows.rdd.getNumPartitions() >= parts:
        return rows
    return cut_lineage(rows.repartition(parts, "v", "label"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows of ``stored`` gathered to blocks of one length of vectors."""
    held: dict[int, list[pa.Table]] = {}

    def filled(dim: int) -> Block:
        table = pa.concat_tables(held.pop(dim))
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(-1, dim)
        label = np.array(table.column("label").to_pylist(), object)
        return Block(x, table.column("ids").to_pylist(), label)

    def rows(dim: int) -> int:
        return sum(t.num_rows for t in held.get(dim, ()))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dim in pc.unique(batch.column(0)).to_pylist():
            held.setdefault(dim, []).append(table.filter(pc.equal(table.column("dim"), dim)))
            if rows(dim) >= min(ROWS, BLOCK // (8 * dim)):
                yield filled(dim)
        if sum(map(rows, held)) >= 2 * ROWS:  # of very many lengths none may fill a block
            yield from map(filled, list(held))
    yield from map(filled, list(held))


def search(
    rows: DataFrame,
    asking: DataFrame,
    start: Callable[[pa.Table], Searcher],
    schema: str,
    by: list[str],
    best: list[Column],
    k: int,
) -> DataFrame:
    """The k best rows that searchers find, by query (``by``) and in the order ``best``, with
    their place as ``rank``.

    ``rows`` are those of ``stored``; ``asking`` holds the queries with a column ``v``. Each
    round's queries are sent to all tasks as one table of some ROUND bytes.
    """
    spark = prepare(rows.sparkSession)
    total = asking.agg(F.sum(F.length("v"))).first()[0] or 0
    rounds = max(1, math.ceil(total / ROUND))
    dealt = asking.withColumn("_round", F.pmod(F.xxhash64("id", "v"), F.lit(rounds)))
    path = f"{checkpoint_folder(spark).rstrip('/')}/varloom-{uuid.uuid4().hex}"
    ranked = W.partitionBy(*by).orderBy(*best)
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(dealt.where(F.col("_round") == i).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = start(sent.value)
            for block in blocks(batches):
                searcher.add(block)
            yield from searcher.found().to_batches(max_chunksize=10_000)

        found = rows.select("dim", "v", "label", "ids").mapInArrow(run, schema)
        found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(found.schema).parquet(path)


def by_length(queries: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The queries' row numbers and vectors by the vectors' length."""
    raw = queries.column("v").to_pylist()
    size = np.array([len(v) // 8 for v in raw], np.int64)
    out = {}
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        out[dim] = rows, np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(-1, dim)
    return out


def exact_in_doubles(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether no sum of products of these whole numbers leaves 53 bits."""
    return np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**53


def inner(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of whole numbers in Python's integers, which have no bounds."""
    own = [int(v) for v in q]
    return [sum(a * b for a, b in zip(map(int, row), own)) for row in x.tolist()]


def merge(
    best: list[tuple], ids: list[list[int]], rows: np.ndarray, scores: list, own: int, k: int
) -> list[tuple]:
    """``best``, a sorted list of (score, id) with the smallest scores first, after the given
    stored rows; ties go to smaller ids, ``own`` is left out."""
    if len(rows) > k + 1:  # a row may hold nothing but the query's own id
        edge = sorted(scores)[k]
        near = [i for i, s in enumerate(scores) if s <= edge]
        rows, scores = rows[near], [scores[i] for i in near]
    pairs = [(s, i) for r, s in zip(rows.tolist(), scores) for i in ids[r] if i != own]
    return sorted(best + pairs)[:k]


def whole_scores(scores: list[int]) -> pa.Array:
    """Scores as 64-bit integers."""
    if any(abs(s) >= 1 << 63 for s in scores):
        raise ValueError("a score among the best leaves 64 bits")
    return pa.array(scores, pa.int64())
