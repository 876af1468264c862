"""Near-duplicate documents: many hash minima, banding, verification, components.

Documents with the same set of shingles become one class first. The classes' minima are cut
into bands; classes that share a band are candidates. In each bucket all members are compared
with the smallest one, then components are formed, and only pairs of a bucket that still lie
in different components are compared with each other. A pair is compared by its signature,
then on the full shingle sets of the texts. No bucket is cut off or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import shingles
from varloom.llm.common import small_batches
from varloom.llm.components import components
from varloom.plans.scale import broadcast_if_small, cut_lineage

BANDS, ROWS = 40, 4
# An estimate of s from n minima has the deviation sqrt(s * (1 - s) / n). Pairs that lie more
# than DEVIATIONS below the threshold are given up; the rest are counted on their full sets.
DEVIATIONS, LONG = 5.2, 1024
# Rows of a bucket compared at once, and rows of small buckets that share a task.
BLOCK, SHARD = 512, 4096


def _least(threshold: tuple[int, int], n: int) -> float:
    s = threshold[0] / threshold[1]
    return s - DEVIATIONS * math.sqrt(s * (1 - s) / n)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimated likeness of signatures of one byte per minimum."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (255 / 256)


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(value: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """For each run of values beginning at ``starts``, the minima of n universal hashes
    a * x + b modulo 2^64, as an array of (runs, n)."""
    a, b = _family(n, seed)
    out = np.empty((n, len(starts)), np.uint64)
    step = 1 << 15
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(value) + step, step)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        low = starts[i]
        high = starts[j] if j < len(starts) else len(value)
        part, own = value[low:high], starts[i:j] - low
        hashed = np.empty_like(part)
        for k in range(n):
            np.multiply(part, a[k], out=hashed)
            hashed += b[k]
            np.minimum.reduceat(hashed, own, out=out[k, i:j])
    return out.T


def fingerprints(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    width: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 11,
) -> DataFrame:
    """(key, n_shingles, d1, d2, bands, signature) of whole texts.

    d1 and d2 are sums over the set: equal sets have equal ones. ``bands`` holds one hash per
    band, ``signature`` one byte per minimum. A text without words has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, salt = _family(rows, seed + 1)
        for batch in small_batches(batches, "_text", 2 << 20):
            value, bounds = shingles.sets(batch.column(1), width)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            d1 = np.zeros(len(size), np.uint64)
            d2 = np.zeros(len(size), np.uint64)
            lists: list = [None] * len(size)
            marks: list = [None] * len(size)
            if len(some):
                starts = bounds[:-1][some]
                d1[some] = np.add.reduceat(value, starts)
                d2[some] = np.add.reduceat(shingles.mix(value + np.uint64(7)), starts)
                low = minima(value, starts, bands * rows, seed)
                cut = low.reshape(len(some), bands, rows)
                band = shingles.mix((shingles.mix(cut) * (salt * np.uint64(2) + np.uint64(1))).sum(axis=2, dtype=np.uint64) + place)
                byte = (shingles.mix(low) >> np.uint64(56)).astype(np.uint8)
                for i, own, mark in zip(some, band.view(np.int64), byte):
                    lists[i], marks[i] = own, mark.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.array(lists, pa.list_(pa.int64())),
                    pa.array(marks, pa.binary()),
                ],
                ["key", "n_shingles", "d1", "d2", "bands", "signature"],
            )

    source = df.selectExpr(f"`{key}` AS key", f"`{text}` AS _text")
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"key {kind}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, "
        "signature binary",
    )


def _alike(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(
                    batch.num_rows, -1
                )
                for i in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array(_agree(x, y) >= least))

    sign = prints.select("key", "signature")
    both = pairs.join(sign.withColumnsRenamed({"key": "a", "signature": "sa"}), "a")
    both = both.join(sign.withColumnsRenamed({"key": "b", "signature": "sb"}), "b")
    kind = prints.schema["key"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _long_signatures(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, long): LONG more minima of each text, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            value, bounds = shingles.sets(batch.column(1), width)
            low = minima(value, bounds[:-1], LONG, seed)
            byte = (shingles.mix(low) >> np.uint64(56)).astype(np.uint8)
            marks = pa.array([x.tobytes() for x in byte], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["key", "long"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, long binary")


def _within_buckets(rows: DataFrame, threshold: tuple[int, int], short: int) -> DataFrame:
    """Pairs (a, b) of a bucket in different components whose signatures may reach the
    threshold; each pair comes from the first bucket that it shares.

    A bucket is cut into blocks, and every two blocks of it are compared in one place, so that
    neither a task nor a table ever holds all pairs of a large bucket.
    """
    up, down = threshold
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    rows = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    shards = max(1, math.ceil(rows.count() / SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)))

    def compare(table: pa.Table) -> pa.Table:
        names = ("bucket", "lo", "hi", "own", "n_shingles")
        bucket, lo, hi, own, size = (table.column(c).to_numpy() for c in names)
        part = table.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
        n = table.num_rows
        mark, long = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(n, -1)
            for c in ("signature", "long")
        )
        band = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        order = np.lexsort((hi, lo, bucket))
        change = np.zeros(n, bool)
        change[0] = True
        for x in (bucket, lo, hi):
            change[1:] |= x[order][1:] != x[order][:-1]
        starts = np.append(np.flatnonzero(change), n)
        found_a, found_b = [], []
        for s, e in zip(starts[:-1], starts[1:]):
            rows = order[s:e]
            one = rows[0]
            left = rows[own[rows] == lo[one]]
            right = left if lo[one] == hi[one] else rows[own[rows] == hi[one]]
            for at in range(0, len(left), 64):
                x = left[at : at + 64]
                fit = part[x][:, None] != part[right][None, :]
                if left is right:
                    fit &= x[:, None] < right[None, :]
                small = np.minimum(size[x][:, None], size[right][None, :])
                large = np.maximum(size[x][:, None], size[right][None, :])
                fit &= small * down >= large * up
                i, j = np.nonzero(fit)
                i, j = x[i], right[j]
                for k in range(0, len(i), 1 << 14):
                    a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    near = _agree(mark[a], mark[b]) >= _least(threshold, short)
                    a, b = a[near], b[near]
                    equal = band[a] == band[b]
                    first = band[a, equal.argmax(axis=1)] == bucket[one]
                    a, b = a[first], b[first]
                    near = _agree(long[a], long[b]) >= _least(threshold, LONG)
                    found_a.append(a[near])
                    found_b.append(b[near])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b))
        keys = table.column("key").combine_chunks()
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b))})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.drop("m", "other").groupBy("shard").applyInArrow(compare, f"a {kind}, b {kind}")


def _confirmed(
    pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]
) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold, counted on the texts."""
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ta", 2 << 20):
            left, at = shingles.sets(batch.column(2), width)
            right, to = shingles.sets(batch.column(3), width)
            good = []
            for i in range(batch.num_rows):
                x, y = left[at[i] : at[i + 1]], right[to[i] : to[i + 1]]
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                shared = int((y[place] == x).sum()) if len(y) else 0
                good.append(down * shared >= up * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a")
    both = both.join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b")
    kind = texts.schema["key"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    width: int = 5,
    threshold: tuple[int, int] = (75, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 11,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of the table.

    Two texts are linked if down * |common shingles| >= up * |all shingles| of the two, for
    ``threshold`` = (up, down). ``component_id`` is the smallest key that links lead to, the
    row's own included; ``kept`` marks the row that has it. The width is that of shingles in
    words; bands and rows set how likely a linked pair shares a bucket: at 0.75, all but one
    in four million do, and linked groups have many ways to be found.

    A NULL text counts as empty; texts without words have no shingles, are linked with
    nothing and kept. Rows with a NULL key cannot be named: they take no part, get a NULL
    component and are kept. Repeated rows come back as often, with the same component. Other
    columns are not read; an empty table gives no rows.
    """
    up, down = threshold
    prints = cut_lineage(
        fingerprints(df, key=key, text=text, width=width, bands=bands, rows=rows, seed=seed)
    )
    named = prints.where("key IS NOT NULL AND n_shingles > 0")
    classes = cut_lineage(
        named.groupBy("d1", "d2", "n_shingles").agg(F.min("key").alias("first"))
    )
    firsts = classes.select(F.col("first").alias("key")).distinct()
    own = cut_lineage(named.join(firsts, "key", "left_semi").dropDuplicates(["key"]))
    placed = own.select("key", "n_shingles", F.explode("bands").alias("bucket"))
    pivots = (
        placed.groupBy("bucket")
        .agg(F.min(F.struct("key", "n_shingles")).alias("p"), F.max("key").alias("last"))
        .where("p.key <> last")
        .select("bucket", F.col("p.key").alias("pivot"), F.col("p.n_shingles").alias("size"))
    )
    # members of buckets with more than one class
    shared = cut_lineage(placed.join(pivots, "bucket"))

    def of_size(x: str, y: str) -> F.Column:
        small, large = F.least(x, y), F.greatest(x, y)
        return small * down >= large * up

    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def needed(keys: DataFrame) -> DataFrame:
        # a broadcast, if counted to be small, keeps all other texts where they are
        wanted = broadcast_if_small(cut_lineage(keys.distinct()), width=1)
        return texts.join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs, those that the full sets confirm."""
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
        return cut_lineage(_confirmed(pairs, needed(ends), width, threshold))

    stars = shared.where(F.col("key") != F.col("pivot")).where(of_size("n_shingles", "size"))
    stars = stars.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    least = _least(threshold, bands * rows)
    links = linked(cut_lineage(_alike(stars, own, least)))
    found = components(links)
    # what is left: pairs of a bucket, pivot aside, that lie in different components
    rest = (
        shared.where(F.col("key") != F.col("pivot"))
        .join(found.withColumnRenamed("id", "key"), "key", "left")
        .select("bucket", "key", F.coalesce("component", "key").alias("c"))
    )
    mixed = rest.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
    rest = cut_lineage(rest.join(mixed.select("bucket"), "bucket", "left_semi"))
    long = _long_signatures(needed(rest.select("key")), width, seed + 2)
    marked = cut_lineage(own.select("key", "n_shingles", "bands", "signature").join(long, "key"))
    pairs = cut_lineage(_within_buckets(rest.join(marked, "key"), threshold, bands * rows))
    more = linked(pairs)
    if not more.isEmpty():
        found = components(links.union(more))
    named_class = classes.join(found.withColumnRenamed("id", "first"), "first", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("component", "first").alias("component_id")
    )
    return (
        prints.join(named_class, ["d1", "d2", "n_shingles"], "left")
        .select(
            "key",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id"))
            .otherwise(F.col("key"))
            .alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col("key").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
        .withColumnRenamed("key", key)
    )
