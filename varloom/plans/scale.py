"""Building blocks that keep hot groups out of single tasks.

* group statistics are partial aggregates joined back, never windows over a group;
* ranks come from a range partition plus offsets, never from one sorted group;
* lineage is cut by checkpoints in the shared folder of the cluster.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="varloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files when they end, not when the driver collects
    garbage; a written table is read instead of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame, *, replaces: DataFrame | None = None) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and go on from there.

    The plan runs once, a lost executor costs a re-read only, and later joins know the size.
    ``replaces`` is a table of an earlier call that nothing reads any more once the new one is
    written; its files are deleted, so that an iteration keeps a bounded number of tables.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/varloom-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    if replaces is not None:
        discard(replaces)
    return out


def cut_in_parts(df: DataFrame, column: str, values: Sequence[int]) -> list[DataFrame]:
    """``cut_lineage`` with the rows of each value of a column in a table of its own, without that
    column; each can be discarded by itself. Rows with other values are not returned."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/varloom-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    jvm, out = spark._jvm, []
    for value in values:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        part = spark.read.schema(schema).parquet(place.toString()) if there else spark.createDataFrame([], schema)
        part._varloom_path = place.toString()
        out.append(part)
    return out


# Rows of a bucket; a task sorts or adds up one bucket at a time.
_BUCKET = 500_000


def buckets_for(rows: int, spark: SparkSession) -> int:
    """How many buckets a table of so many rows gets."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, rows // 10_000), -(-rows // _BUCKET))


def bucketed(
    df: DataFrame, key: str, n: int, *, in_place: bool = False, replaces: DataFrame | None = None
) -> DataFrame:
    """``cut_lineage`` with the rows of equal keys in one of ``n`` files.

    Joins and sums by the key then need no shuffle, however often the table is read. With
    ``in_place`` the rows come from a table with the same buckets and are not dealt again.
    """
    spark = df.sparkSession
    name = f"varloom_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}"
    rows = df if in_place else df.repartition(n, key)
    with _shuffles_removed(spark):
        rows.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._varloom_path, out._varloom_table = path, name
    if replaces is not None:
        discard(replaces)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` or ``bucketed`` wrote."""
    path = df.__dict__.get("_varloom_path")
    if path is None:
        raise ValueError("only a table made by cut_lineage can be discarded")
    if "_varloom_table" in df.__dict__:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._varloom_table}")
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of each group to its rows: partial aggregation, then an equi-join."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def ranked(
    df: DataFrame,
    order: Sequence[str | Column],
    *,
    by: Sequence[str] = (),
    out: str = "rank",
) -> DataFrame:
    """Number the rows 1..n in sort order, over the table or within each ``by`` group.

    The sort must be total (end it with a unique key). Rows are range-partitioned on
    (by, order), so one hot group is spread over many partitions. The ranged rows are
    written out once: the counting and the numbering read the same partition bounds, also
    after the loss of an executor.
    """
    cols = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    spread = cut_lineage(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", _OFFSET_BITS))
    )
    # one row per shuffle partition, so this window and this broadcast stay small
    offsets = (
        spread.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_off",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_pid", "_off")
    )
    numbered = spread.join(F.broadcast(offsets), "_pid").withColumn(
        out, F.col("_off") + F.col("_mid").bitwiseAND((1 << _OFFSET_BITS) - 1) + 1
    )
    numbered = numbered.drop("_mid", "_pid", "_off")
    if not by:
        return numbered
    # few groups are sent to the rows; dealing the rows by group would put a large one in one task
    first = broadcast_if_small(cut_lineage(numbered.groupBy(*by).agg(F.min(out).alias("_first"))))
    if len(by) == 1 and not df.schema[by[0]].nullable:
        joined = numbered.join(first, list(by))
    else:
        renamed = first.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_first")
        match = [numbered[c].eqNullSafe(renamed[f"_by_{c}"]) for c in by]
        joined = numbered.join(renamed, match).drop(*[f"_by_{c}" for c in by])
    return joined.withColumn(out, F.col(out) - F.col("_first") + 1).drop("_first")


def tie_ranks(
    df: DataFrame, value: str, *, by: Sequence[str] = (), absent: DataFrame | None = None
) -> DataFrame:
    """One row per distinct (by, value) with its count and its lowest and highest rank.

    Ties collapse in the partial aggregate first, so a value that holds a third of all
    rows is a single row before anything is sorted. ``absent`` (by, n) tells how many rows
    of each group are not stored because they are zeros; they are ranked as if they were.
    """
    keys = [*by, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    if absent is not None:
        zero = F.lit(0).cast(df.schema[value].dataType).alias(value)
        more = absent.where("n > 0").select(*by, zero, F.col("n").cast("long"))
        counts = counts.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))
    cols = [F.col(c) for c in keys]
    spread = cut_lineage(
        counts.repartitionByRange(*cols).withColumn("_pid", F.spark_partition_id())
    )
    within = W.partitionBy("_pid").orderBy(*cols)
    running = spread.withColumn("_cum", F.sum("n").over(within))
    offsets = (
        spread.groupBy("_pid")
        .agg(F.sum("n").alias("_n"))
        .withColumn(
            "_off",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_pid", "_off")
    )
    out = running.join(F.broadcast(offsets), "_pid").withColumn(
        "hi", F.col("_off") + F.col("_cum")
    )
    if by:
        starts = out.groupBy(*by).agg(F.min(F.col("hi") - F.col("n")).alias("_start"))
        out = out.join(starts, list(by)).withColumn("hi", F.col("hi") - F.col("_start"))
    return out.withColumn("lo", F.col("hi") - F.col("n") + 1).select(*keys, "n", "lo", "hi")


def hash_order(seed: int, *keys: str) -> Column:
    """A reproducible random order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over a few tasks for each core, before each of them becomes very many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


# Rows that are packed in a block at most, even if all of them belong to one group.
_PACK = 1 << 16


def block_of(df: DataFrame, key: str, *, least: int = 1) -> Column:
    """Which of a group's blocks a row goes to, by a hash of its key; of at least so many blocks."""
    return F.pmod(F.xxhash64(key), F.lit(max(least, -(-df.count() // _PACK))))


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether the table has at most ``max_rows`` rows; stops counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(
    df: DataFrame, *, width: int = 32, max_bytes: int = 64 << 20
) -> DataFrame:
    """Hint a broadcast when rows of ``width`` numbers stay within the byte bound; else the
    join is a shuffle that AQE may still turn around once it knows the sizes."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes // (8 * width + 64)) else df


def settled(history: Sequence[float], tolerance: float | None) -> bool:
    """Whether the last step of a fit changed its measure by less than a share of it."""
    if tolerance is None or len(history) < 2:
        return False
    return abs(history[-1] - history[-2]) <= tolerance * abs(history[-1])
