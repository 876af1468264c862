"""Choose documents so that the token shares of a tree of sources meet target weights.

The tree has one level per column, for instance domain, language and source. A budget goes
down from the root by weight. A node can take at most ``max_epochs`` times the tokens below
it; what a node cannot take is shared out among its siblings, and only what a whole family
cannot take goes to the siblings of their parent. A leaf then takes whole epochs of its rows
and, of one more epoch, the prefix in a seeded order that fits in what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.llm.common import running_sum
from varloom.plans.scale import cut_lineage

NO_NAME = "(none)"


def word_count(text: Column) -> Column:
    """Number of words; none in NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allocate(
    leaves: DataFrame,
    path: Sequence[str],
    weights: Sequence[Mapping[str, float]],
    budget: int,
    max_epochs: int,
) -> DataFrame:
    """(path..., available, granted): tokens granted to each leaf of (path..., available).

    ``weights`` has a mapping by level from a node's name to its weight; a name that is not in
    it weighs 1, one with a weight of 0 takes nothing. Each level is one window over the
    children of a node, in the order in which they fill up.
    """
    depth = len(path)
    levels = [None] * (depth + 1)
    weight = []
    for name, given in zip(path, weights):
        w = F.lit(1.0)
        for child, value in given.items():
            w = F.when(F.col(name) == child, F.lit(float(value))).otherwise(w)
        weight.append(w)
    levels[depth] = leaves.select(
        *path, F.when(weight[-1] > 0, F.col("available") * max_epochs).otherwise(0).alias("cap")
    )
    for d in range(depth - 1, 0, -1):
        below = levels[d + 1].groupBy(*path[:d]).agg(F.sum("cap").alias("cap"))
        levels[d] = below.withColumn("cap", F.when(weight[d - 1] > 0, F.col("cap")).otherwise(0))
    granted = None
    for d in range(1, depth + 1):
        nodes = levels[d].withColumn("w", weight[d - 1])
        if granted is None:
            nodes = nodes.withColumn("parent", F.lit(float(budget)))
            family = W.partitionBy(F.lit(0))
        else:
            nodes = nodes.join(granted.withColumnRenamed("granted", "parent"), list(path[: d - 1]))
            family = W.partitionBy(*path[: d - 1])
        fills = F.when(F.col("w") > 0, F.col("cap") / F.col("w"))
        order = family.orderBy(fills.asc_nulls_last(), path[d - 1])
        before = order.rowsBetween(W.unboundedPreceding, -1)
        nodes = nodes.select(
            "*",
            (F.col("parent") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
            (F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest"),
        ).withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * F.col("left"))
        open_node = F.when(~F.col("full"), F.struct("cap", "left", "rest"))
        first = F.first(open_node, ignorenulls=True).over(
            order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        )
        nodes = nodes.withColumn("first", first)
        share = F.col("w") * F.col("first.left") / F.col("first.rest")
        granted = nodes.select(
            *path[:d], F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("granted")
        )
        granted = cut_lineage(granted)
    return leaves.join(granted, list(path)).select(
        *path, "available", F.floor("granted").cast("long").alias("granted")
    )


def mix(
    df: DataFrame,
    *,
    key: str,
    tokens: str,
    path: Sequence[str],
    weights: Sequence[Mapping[str, float]],
    budget_share: float,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """(key, path..., tokens, copies): how often each row is taken.

    The budget is ``budget_share`` of all tokens. A leaf's copies are its whole epochs, and one
    more for rows of the prefix, whose tokens together fit in what is left. The order of an
    epoch is that of md5("seed|epoch|key"). The selection of a leaf is a running sum over a
    range-partitioned order, so that no leaf lies in one task.

    A NULL in the path is a name of its own, "(none)"; NULL or negative tokens count as 0, and
    such rows go with the prefix they fall in; repeated rows are taken one after another; a
    NULL key is an empty one in the order. Other columns are not read, and those of the path may
    have any names. An empty table gives no rows.
    """
    given, path = list(path), [f"_path{i}" for i in range(len(path))]
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NO_NAME)).alias(p) for c, p in zip(given, path)]
    count = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = cut_lineage(df.select(F.col(key).alias("_key"), *named, count.alias("_tokens")))
    leaves = cut_lineage(rows.groupBy(*path).agg(F.sum("_tokens").alias("available")))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    granted = allocate(leaves, path, weights, int(total * budget_share), max_epochs)
    size = F.greatest("available", F.lit(1))
    granted = cut_lineage(
        granted.select(
            *path,
            F.floor(F.col("granted") / size).cast("long").alias("_epochs"),
            (F.col("granted") % size).cast("long").alias("_rest"),
        )
    )
    label = F.concat_ws(
        "|", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("_key").cast("string"), F.lit(""))
    )
    placed = rows.join(granted, path).withColumn("_place", F.md5(label.cast("binary")))
    summed = running_sum(placed, ["_place"], {"_until": "_tokens"}, path)
    copies = F.col("_epochs") + F.when(F.col("_until") <= F.col("_rest"), 1).otherwise(0)
    return summed.select(
        F.col("_key").alias(key),
        *[F.col(p).alias(c) for c, p in zip(given, path)],
        F.col("_tokens").alias(tokens),
        copies.cast("long").alias("copies"),
    )
