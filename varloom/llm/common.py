"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.plans.scale import cut_lineage
from varloom.session import tune

# Rows in an Arrow batch, so that batches of long texts stay within a worker's memory.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for text in Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``max_bytes``, one text at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large binary column: row i holds the bytes of data[bounds[i]:bounds[i + 1]]."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [
            None,
            pa.py_buffer((bounds.astype(np.int64) * width).tobytes()),
            pa.py_buffer(np.ascontiguousarray(data)),
        ],
    ).cast(pa.binary())


def running_sum(
    df: DataFrame, order: list[str | Column], values: dict[str, str], by: list[str]
) -> DataFrame:
    """Add, per ``by`` group, the sums of columns over all rows up to each row in the order.

    ``values`` maps new columns to summed ones. Rows are range-partitioned on (by, order) and
    written once, so that a group with a third of all rows lies in many tasks: each task sums
    its own rows, and the totals of earlier tasks of the group are added. The order must be
    total within a group, or equal rows interchangeable.
    """
    pid, bases = fresh(df, "_pid", *[f"_base_{v}" for v in values])[0], None
    keys = [F.col(c) for c in by]
    cols = keys + [F.col(c) if isinstance(c, str) else c for c in order]
    spread = cut_lineage(df.repartitionByRange(*cols).withColumn(pid, F.spark_partition_id()))
    inside = W.partitionBy(pid, *by).orderBy(*cols[len(by) :]).rowsBetween(
        W.unboundedPreceding, 0
    )
    before = W.partitionBy(*by).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    bases = [f"_base_{v}" for v in values]
    totals = spread.groupBy(*by, pid).agg(
        *[F.sum(c).alias(f"_sum_{v}") for v, c in values.items()]
    )
    totals = totals.select(
        *[F.col(c).alias(f"_key_{c}") for c in by],
        F.col(pid).alias("_key_pid"),
        *[
            F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(b)
            for v, b in zip(values, bases)
        ],
    )
    match = (F.col(pid) == F.col("_key_pid")) if not by else None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        match = same if match is None else match & same
    if by:
        match = match & (F.col(pid) == F.col("_key_pid"))
    summed = spread.select(
        "*", *[F.sum(c).over(inside).alias(f"_part_{v}") for v, c in values.items()]
    )
    joined = summed.join(totals, match)
    return joined.select(
        *df.columns,
        *[(F.col(f"_part_{v}") + F.col(b)).alias(v) for v, b in zip(values, bases)],
    )
