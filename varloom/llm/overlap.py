"""Jaccard join of word n-grams by T-occurrence search over inverted lists.

Two sets of sizes m <= n reach a Jaccard threshold s only if they share T = ceil(s * n) tokens
or more. DivideSkip leaves the longest inverted lists of a query out of the merge: the short
ones are merged through a heap, and records that occur there often enough are looked up in the
long lists by binary search.

The same division decides over the whole table which lists meet at all. Of each set, the
n - T + t tokens with the smallest hashes are posted, t = min(EXTRA, T). Of two sets that
reach the threshold, at least t of these are common, for the larger set's t. Each set then
gives up its t - 1 longest lists, with lengths counted over the whole table; both do so in one
order, so that a common list is left. Lists of one member are of no use, and long lists, such
as those of a passage that a million texts repeat, are given up by nearly all their members.

What is left decides who meets whom; every set then lies in one block of records with its own
inverted lists, and asks the blocks that hold a member of one of its lists.

In a large table most tokens stand in several sets by chance, so that sets meet many that are not
like them. Before any text moves, a set meets the others as a sketch: the parities of its tokens'
counts in m buckets, m being about half its size. Two sketches differ in at most as many places as
the sets do, and two like sets differ in few, so that only sets with a chance are searched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.llm import shingles
from varloom.llm.common import binary_rows, small_batches
from varloom.llm.components import components
from varloom.plans.scale import broadcast_if_small, cut_lineage

EXTRA = 32
# Bytes of sets in a block of records, in the queries that meet it at once, and in a task's share
# of small blocks. A set counts as SMALL tokens at least.
BLOCK, ASKING, SHARD, SMALL = 4 << 20, 16 << 20, 16 << 20, 1024
# How much a binary probe costs beside a step of the merge, by the logarithm of the list.
PROBE = 0.0085


class Lists:
    """The inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.token, place = np.unique(np.concatenate(sets), return_inverse=True)
        # (list, member) as one number each, in order
        self.entry = np.sort(place * self.n + owner)
        self.starts = np.searchsorted(self.entry, np.arange(len(self.token) + 1) * self.n)

    def search(self, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The records that share at least ``least[record]`` tokens with the set ``own``, and how
        many they share. A record with a bound of 0 is not looked for."""
        wanted = least > 0
        none = np.zeros(0, np.int64)
        if not wanted.any():
            return none, none
        at = np.searchsorted(self.token, own)
        at[at == len(self.token)] = 0
        lists = at[self.token[at] == own]
        needed = int(least[wanted].min())
        if len(lists) < needed:
            return none, none
        length = self.starts[lists + 1] - self.starts[lists]
        order = np.argsort(length, kind="stable")
        widest = math.log2(int(length[order[-1]]) + 1)
        n_long = min(needed - 1, int(needed / (PROBE * widest + 1)))
        short, long = np.split(lists[order], [len(lists) - n_long])
        rows, seen = self._merged(short, needed - n_long)
        fit = wanted[rows] & (seen >= least[rows] - n_long)
        rows, seen = rows[fit], seen[fit]
        for i in range(0, len(rows), step := max(1, (1 << 20) // max(1, n_long))):
            keys = long * self.n + rows[i : i + step, None]
            found = np.searchsorted(self.entry, keys)
            found[found == len(self.entry)] = 0
            seen[i : i + step] += (self.entry[found] == keys).sum(axis=1)
        good = seen >= least[rows]
        return rows[good], seen[good]

    def _merged(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The members of at least ``least`` of the lists, merged through a heap."""
        members = [
            (self.entry[self.starts[i] : self.starts[i + 1]] - i * self.n).tolist() for i in lists
        ]
        merged = np.fromiter(heapq.merge(*members), np.int64)
        first = np.flatnonzero(np.diff(merged, prepend=-1))
        times = np.diff(np.append(first, len(merged)))
        enough = times >= least
        return merged[first[enough]], times[enough]


def _least(up: int, down: int) -> Column:
    """How many tokens a set shares at least with any one like it."""
    return F.expr(f"CAST((n_shingles * {up} + {down - 1}) DIV {down} AS INT)")


def _read(
    df: DataFrame,
    key: str,
    text: str,
    width: int,
    out: str,
    last: Callable[[pa.Array, np.ndarray, np.ndarray], list[pa.Array]],
) -> DataFrame:
    """(key, n_shingles, d1, d2) of whole texts and more columns, ``out``. d1 and d2 are sums
    over the set: equal sets have equal ones."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 2 << 20):
            value, bounds = shingles.sets(batch.column(1), width)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            sums = np.zeros((2, len(size)), np.uint64)
            if len(some):
                starts = bounds[:-1][some]
                sums[0, some] = np.add.reduceat(value, starts)
                sums[1, some] = np.add.reduceat(shingles.mix(value + np.uint64(7)), starts)
            columns = [batch.column(0), pa.array(size), *map(pa.array, sums.view(np.int64))]
            columns += last(batch.column(1), value, bounds)
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_shingles", "d1", "d2", *names])

    source = df.selectExpr(f"`{key}` AS key", f"`{text}` AS _text")
    own = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {own}, n_shingles bigint, d1 bigint, d2 bigint, {out}")


def _buckets(size: np.ndarray) -> np.ndarray:
    """Bits in the sketch of a set of each size: the power of two from half the size, 64 at least."""
    return 1 << np.ceil(np.log2(np.maximum(size, 128) / 2)).astype(np.int64)


def _sketches(value: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The parities of each set's tokens by bucket, packed in bytes."""
    size = np.diff(bounds)
    bits = _buckets(size)
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(ends[:-1], size) + (value.view(np.int64) & (np.repeat(bits, size) - 1))
    odd = np.bincount(at, minlength=ends[-1]) & 1
    return binary_rows(np.packbits(odd.astype(np.uint8)), ends // 8)


def _posted(up: int, down: int) -> Callable[[pa.Array, np.ndarray, np.ndarray], list[pa.Array]]:
    """The tokens of each set that are posted, those with the smallest hashes, and its sketch."""

    def columns(text: pa.Array, value: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        size = np.diff(bounds)
        least = -(-size * up // down)
        count = size - least + np.minimum(EXTRA, least)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], count)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[at].view(np.int64)))
        return [tokens, _sketches(value, bounds)]

    return columns


def _kept(posted: DataFrame, least: Column) -> DataFrame:
    """(token, cid, n_shingles) of lists that a set does not give up; no list of one member."""
    # written, so that its shuffle is gone before the next one
    counts = cut_lineage(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    own = W.partitionBy("cid")
    held = posted.join(counts, "token").withColumn("k", F.count("*").over(own))
    held = held.withColumn("place", F.row_number().over(own.orderBy("df", "token")))
    return held.where(F.col("place") <= F.col("k") + 1 - F.least(F.lit(EXTRA), least)).select(
        "token", "cid", "n_shingles"
    )


def _sharded(rows: DataFrame, size: Column) -> DataFrame:
    """The rows with the ``shard`` of their unit, of about SHARD bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD))
    return rows.withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)))


def _screened(rows: DataFrame, sketches: DataFrame, up: int, down: int) -> DataFrame:
    """The rows for ``_search`` that have a partner in their unit with a sketch that can be like
    theirs; ``sketches`` is (cid, sketch). Two sets that reach the threshold differ in at most
    (down - up) / (down + up) of the sum of their sizes."""
    rows = cut_lineage(rows)
    names = ["unit", "asks", "cid", "n_shingles", "component"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    dealt = _sharded(rows, F.col("n_shingles") / 8 + 64)

    def run(table: pa.Table) -> pa.Table:
        cid, part, size = (table.column(c).to_numpy() for c in ("cid", "component", "n_shingles"))
        asks = table.column("asks").to_numpy().astype(bool)
        unit = table.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
        sketch = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("sketch")]
        words = _buckets(size) // 64
        good = np.zeros(len(cid), bool)
        order = np.argsort(unit, kind="stable")
        heads = np.flatnonzero(np.diff(unit[order], prepend=-1))
        for one in np.split(order, heads[1:]):
            records, queries = one[~asks[one]], one[asks[one]]
            for m in np.unique(words[queries]):
                asking = queries[words[queries] == m]
                near = records[(words[records] >= m) & (size[records] * up <= size[asking].max() * down)]
                if not len(near):
                    continue
                # the halves of a sketch add up to one of half the buckets
                own = np.stack([np.bitwise_xor.reduce(sketch[i].reshape(-1, m), axis=0) for i in near])
                n, who, where = size[near], cid[near], part[near]
                for q in asking:
                    fit = (n > size[q]) | ((n == size[q]) & (who > cid[q]))
                    fit &= (size[q] * down >= n * up) & (where != part[q])
                    at = np.flatnonzero(fit)
                    apart = np.bitwise_count(own[at] ^ sketch[q]).sum(axis=1, dtype=np.int64)
                    at = at[apart * (down + up) <= (down - up) * (n[at] + size[q])]
                    good[near[at]] = True
                    good[q] |= len(at) > 0
        return table.select(names).filter(pa.array(good))

    joined = broadcast_if_small(dealt, width=12).join(sketches, "cid")
    return cut_lineage(joined.groupBy("shard").applyInArrow(run, kinds), replaces=rows)


def _search(rows: DataFrame, texts: Callable[[DataFrame], DataFrame], width: int, up: int, down: int) -> DataFrame:
    """(a, b): links between the queries and the records of each unit, as a forest.

    ``rows`` is (unit, asks, cid, n_shingles, component), ``texts`` gives (cid, text) for a table of
    cid: texts take less room on the way than their sets. A query looks for records that are larger, or as large with
    a larger number, and lie in another component; a link between two that earlier links of the
    unit have joined already is left out.
    """
    found = texts(rows.select("cid").distinct())
    rows = _sharded(rows, F.col("n_shingles") * 8)
    rows = broadcast_if_small(rows, width=12).join(found, "cid")

    def run(table: pa.Table) -> pa.Table:
        cid, part = (table.column(c).to_numpy() for c in ("cid", "component"))
        asks = table.column("asks").to_numpy().astype(bool)
        unit = table.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
        sets = []
        for batch in small_batches(iter(table.select(["text"]).to_batches()), "text", 2 << 20):
            value, bounds = shingles.sets(batch.column(0), width)
            sets += [value[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        size = np.array([len(x) for x in sets], np.int64)
        order = np.lexsort((cid, size, asks, unit))
        heads = np.flatnonzero(np.diff(unit[order], prepend=-1))
        a, b = [], []
        for one in np.split(order, heads[1:]):
            root = {c: c for c in part[one].tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            records, queries = one[~asks[one]], one[asks[one]]
            if not len(records) or not len(queries):
                continue
            lists = Lists([sets[i] for i in records])
            n, who = size[records], cid[records]
            for q in queries:
                now = find(part[q])
                larger = (n > size[q]) | ((n == size[q]) & (who > cid[q]))
                fit = larger & (size[q] * down >= n * up)
                # records that earlier links have joined to this query need no look
                for i in np.flatnonzero(fit):
                    fit[i] = find(part[records[i]]) != now
                least = -(-(n + size[q]) * up // (up + down))
                found, _ = lists.search(sets[q], np.where(fit, least, 0))
                for i in records[found]:
                    x, y = find(part[q]), find(part[i])
                    if x != y:
                        root[y] = x
                        a.append(cid[q])
                        b.append(cid[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("shard").applyInArrow(run, "a bigint, b bigint")


def _weight(per: int) -> Column:
    return F.ceil(F.sum(F.greatest("n_shingles", F.lit(SMALL)) * 8) / per).cast("int")


def _dealt(*by: str) -> Column:
    return F.pmod(F.xxhash64("cid", *by), F.col("parts")).cast("int")


def _stars(kept: DataFrame, up: int, down: int) -> DataFrame:
    """Units of each list's smallest set and the others: one query, records in blocks."""
    first = F.min(F.struct("n_shingles", "cid")).alias("p")
    pivots = kept.groupBy("token").agg(first)
    pairs = kept.join(pivots, "token").where("cid <> p.cid")
    pairs = pairs.where(F.col("p.n_shingles") * down >= F.col("n_shingles") * up)
    pairs = pairs.select("p", "cid", "n_shingles").distinct()
    pairs = cut_lineage(pairs.select(F.col("p.cid").alias("pivot"), F.col("p.n_shingles").alias("size"), "cid", "n_shingles"))
    parts = pairs.groupBy("pivot").agg(_weight(BLOCK).alias("parts"))
    records = pairs.join(parts, "pivot").withColumn("part", _dealt())
    asking = records.select("pivot", "part", F.col("pivot").alias("cid"), F.col("size").alias("n_shingles"))
    records = records.select("pivot", "part", "cid", "n_shingles", F.lit(False).alias("asks"))
    both = records.unionByName(asking.distinct().withColumn("asks", F.lit(True)))
    unit = F.concat_ws("|", "pivot", "part").alias("unit")
    return both.select(unit, "asks", "cid", "n_shingles", F.col("cid").alias("component"))


def _blocks(kept: DataFrame, found: DataFrame, up: int, down: int) -> DataFrame:
    """Units of all sets that share a list but no component yet: every set is a record of one
    block, that of the longest of its lists, and asks all blocks where its lists have members."""
    rows = kept.join(found.withColumnRenamed("id", "cid"), "cid", "left")
    rows = rows.withColumn("component", F.coalesce("component", "cid"))
    mixed = rows.groupBy("token").agg(
        F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    rows = cut_lineage(rows.join(mixed.where("x <> y").select("token", "m"), "token"))
    home = rows.groupBy("cid", "n_shingles", "component").agg(
        F.max(F.struct("m", "token"))["token"].alias("home")
    )
    parts = home.groupBy("home").agg(_weight(BLOCK).alias("parts"))
    place = cut_lineage(
        home.join(parts, "home").select(
            "cid", "n_shingles", "component", "home", _dealt().alias("part")
        )
    )
    seen = rows.select("token", "cid").join(place, "cid").groupBy("token", "home", "part").agg(
        F.min("n_shingles").alias("low"),
        F.max("n_shingles").alias("high"),
        F.min("component").alias("x"),
        F.max("component").alias("y"),
    )
    worth = (F.col("high") >= F.col("n_shingles")) & (F.col("n_shingles") * down >= F.col("low") * up)
    worth = worth & ((F.col("x") != F.col("component")) | (F.col("y") != F.col("component")))
    visits = cut_lineage(
        rows.join(seen, "token")
        .where(worth)
        .select("cid", "n_shingles", "component", "home", "part")
        .distinct()
    )
    parts = visits.groupBy("home", "part").agg(_weight(ASKING).alias("parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("turn")
    unit = F.concat_ws("|", "home", "part", "turn").alias("unit")
    own = ["cid", "n_shingles", "component", unit]
    records = place.join(parts, ["home", "part"]).select("*", every).select(*own)
    asking = visits.join(parts, ["home", "part"]).withColumn("turn", _dealt("home"))
    asking = asking.select(*own)
    return records.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))


def jaccard_classes(
    df: DataFrame,
    *,
    key: str,
    text: str = "text",
    width: int = 4,
    threshold: tuple[int, int] = (85, 100),
) -> DataFrame:
    """(key, n_shingles, component_id) for each row of the table.

    Two texts are linked if down * |common shingles| >= up * |all shingles| of the two, for
    ``threshold`` = (up, down). ``component_id`` is the smallest key that links lead to, the
    row's own included. The search is exact: no list, block or partner is capped or sampled.

    A NULL text counts as empty; texts without words have no shingles and are linked with
    nothing. Rows with a NULL key cannot be named: they take no part and get a NULL component.
    Repeated rows come back as often, with the same component; of a key with several texts, each
    row has the component of its own text. Other columns are not read; an empty table gives no
    rows.
    """
    up, down = threshold
    posted = _read(df, key, text, width, "tokens array<bigint>, sketch binary", _posted(up, down))
    prints = cut_lineage(posted.withColumn("row", F.monotonically_increasing_id()))
    named = prints.where("key IS NOT NULL AND n_shingles > 0")
    by = ["d1", "d2", "n_shingles"]
    classes = cut_lineage(
        named.groupBy(*by).agg(F.min("key").alias("first"), F.min("row").alias("cid"))
    )
    # one row of each class posts its tokens; a broadcast, if counted to be small, moves no others
    cids = classes.select(F.col("cid").alias("row"))
    copies = cut_lineage(named.select("row").join(cids, "row", "left_anti"))
    one = named.join(broadcast_if_small(copies, width=1), "row", "left_anti")
    lists = one.select(F.col("row").alias("cid"), "n_shingles", F.explode("tokens").alias("token"))
    kept = cut_lineage(_kept(lists, _least(up, down)))
    shared = kept.groupBy("token").count().where("count > 1").select("token")
    kept = cut_lineage(kept.join(shared, "token", "left_semi"), replaces=kept)

    # nothing reads the posted tokens any more
    prints = cut_lineage(prints.drop("tokens"), replaces=prints)
    named = prints.where("key IS NOT NULL AND n_shingles > 0")
    met = broadcast_if_small(cut_lineage(kept.select("cid").distinct()), width=1)
    sketches = cut_lineage(named.join(met, F.col("row") == F.col("cid")).select("cid", "sketch"))

    def texts(cids: DataFrame) -> DataFrame:
        """The text of one row for each of the classes."""
        needed = cut_lineage(cids.join(classes, "cid"))
        firsts = broadcast_if_small(needed.select(F.col("first").alias(key)).distinct(), width=1)
        rows = df.select(key, text).join(firsts, key, "left_semi")
        read = _read(rows, key, text, width, "text string", lambda own, value, bounds: [own.cast(pa.string())])
        match = broadcast_if_small(needed.withColumnRenamed("first", "key"), width=5)
        found = read.join(match, ["key", *by]).select("cid", "text")
        once = named.join(needed.select(F.col("first").alias("key"), *by), ["key", *by], "left_semi")
        if once.count() > needed.count():  # rows that repeat a key and a text
            found = found.dropDuplicates(["cid"])
        return cut_lineage(found)

    stars = _screened(_stars(kept, up, down), sketches, up, down)
    links = cut_lineage(_search(stars, texts, width, up, down))
    blocks = _screened(_blocks(kept, components(links), up, down), sketches, up, down)
    more = cut_lineage(_search(blocks, texts, width, up, down))
    found = components(links.union(more)).withColumnRenamed("id", "cid")
    whole_of = classes.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = whole_of.groupBy("component").agg(F.min("first").alias("component_id"))
    named_class = whole_of.join(smallest, "component").select(*by, "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    out = prints.select("key", *by).join(named_class, by, "left")
    return out.select(
        F.col("key").alias(key),
        "n_shingles",
        F.when(F.col("key").isNotNull(), own).alias("component_id"),
    )
