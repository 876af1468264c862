"""Choosing tests: LD pruning, sampling, greedy de-duplication, top tests, set operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.plans.scale import broadcast_if_small, cut_lineage, hash_order, ranked, tie_ranks

_BATCH = 256  # candidates of a gene compared at a time


def _unit_vectors(genotype: DataFrame, variant: str, individual: str, dosage: str) -> DataFrame:
    """One unit vector of centred dosages for each variant, donors in id order."""
    stats = genotype.groupBy(variant).agg(F.avg(dosage).alias("_m"))
    filled = genotype.join(stats, variant).withColumn(
        "_x", F.coalesce(F.col(dosage) - F.col("_m"), F.lit(0.0))
    )
    # an array holds one entry for each donor
    rows = filled.groupBy(variant).agg(
        F.sqrt(F.sum(F.col("_x") ** 2)).alias("_norm"),
        F.array_sort(F.collect_list(F.struct(individual, "_x"))).alias("_v"),
    )
    return rows.select(
        variant,
        F.transform(
            "_v", lambda e: F.when(F.col("_norm") > 0, e["_x"] / F.col("_norm")).otherwise(0.0)
        ).alias("_unit"),
    )


def ld_prune(
    pairs: DataFrame,
    genotype: DataFrame,
    max_r2: float,
    seed: int = 0,
    *,
    gene: str = "gene_id",
    variant: str = "variant_id",
    individual: str = "individual_id",
    dosage: str = "dosage",
    batch: int = _BATCH,
) -> DataFrame:
    """Per gene, in a reproducible random order, keep a variant when its r squared with every
    kept variant is below the limit.

    Each round settles the next ``batch`` candidates of every gene among themselves and then
    drops the later candidates that are tied to a kept one. A task sees at most ``batch``
    vectors of a gene; the rounds go on until no candidate is left.
    """
    units = _unit_vectors(genotype, variant, individual, dosage)
    left = cut_lineage(
        pairs.select(gene, variant)
        .distinct()
        .join(units, variant)
        .withColumn("_order", hash_order(seed, gene, variant))
        .select(gene, variant, "_order", "_unit")
    )
    kept_rounds = []
    by_gene = Window.partitionBy(gene).orderBy("_order", variant)
    schema = left.schema
    gene_type = schema[gene].dataType.simpleString()

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", variant])
        vectors = np.stack(frame["_unit"].to_numpy())
        chosen: list[int] = []
        for i in range(len(frame)):
            if not chosen or np.max((vectors[chosen] @ vectors[i]) ** 2) < max_r2:
                chosen.append(i)
        return frame.iloc[chosen]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate(frame["_unit"].to_numpy())
        return pd.DataFrame({gene: [frame[gene].iloc[0]], "_kept": [flat]})

    def screen(batches):
        for frame in batches:
            keep = []
            for unit, flat in zip(frame["_unit"], frame["_kept"]):
                r = np.reshape(flat, (-1, len(unit))) @ unit
                keep.append(np.max(r * r) < max_r2)
            yield frame.loc[np.array(keep, dtype=bool), [*schema.names]]

    while True:
        # row_number with a limit is cut to the limit on each partition before the shuffle
        head = left.withColumn("_k", F.row_number().over(by_gene)).where(F.col("_k") <= batch)
        head = head.drop("_k")
        kept = cut_lineage(head.groupBy(gene).applyInPandas(settle, schema))
        kept_rounds.append(kept.select(gene, variant))
        packed = kept.groupBy(gene).applyInPandas(
            pack, f"`{gene}` {gene_type}, _kept array<double>"
        )
        later = left.join(head.select(gene, variant), [gene, variant], "left_anti")
        left = cut_lineage(later.join(packed, gene).mapInPandas(screen, schema))
        if left.isEmpty():
            break
    out = kept_rounds[0]
    for part in kept_rounds[1:]:
        out = out.unionByName(part)
    return pairs.join(out, [gene, variant], "left_semi")


def greedy_distinct(
    tests: DataFrame,
    order: Sequence[str | Column],
    *,
    keys: Sequence[str] = ("gene_id", "variant_id"),
) -> DataFrame:
    """In the given order keep a test only if its gene and its variant are both new.

    A test that comes first for every one of its keys is certain to be kept; it removes the
    tests that share a key. Repeating this gives the result of the one-by-one scan, because
    a test only ever waits for earlier tests with a common key.
    """
    rest = cut_lineage(ranked(tests, [*order, *keys], out="_rank"))
    chosen = []
    while True:
        first = rest
        for key in keys:
            best = rest.groupBy(key).agg(F.min("_rank").alias(f"_first_{key}"))
            first = first.join(best, key)
        for key in keys:
            first = first.where(F.col("_rank") == F.col(f"_first_{key}"))
        first = cut_lineage(first.select(*rest.columns))
        chosen.append(first)
        for key in keys:
            rest = rest.join(first.select(key), key, "left_anti")
        rest = cut_lineage(rest)
        if rest.isEmpty():
            break
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def dedupe_tests(
    results: DataFrame,
    order: Sequence[str | Column],
    max_n: int | None = None,
    *,
    gene: str = "gene_id",
    variant: str = "variant_id",
) -> DataFrame:
    """Result rows in order with new gene and new variant, up to an optional number."""
    kept = greedy_distinct(results, order, keys=(gene, variant))
    if max_n is not None:
        kept = ranked(kept.withColumnRenamed("_rank", "_place"), ["_place"], out="_rank")
        kept = kept.where(F.col("_rank") <= max_n).drop("_place")
    return kept.drop("_rank")


def sample_tests(
    results: DataFrame,
    n: int,
    by: str,
    seed: int = 0,
    *,
    by_order: Sequence | None = None,
    gene: str = "gene_id",
    variant: str = "variant_id",
) -> DataFrame:
    """``n`` random tests of each type, then a test is dropped if its gene or its variant
    was already used by an earlier type or by an earlier test."""
    hashed = results.withColumn("_h", hash_order(seed, by, gene, variant))
    drawn = ranked(hashed, ["_h", gene, variant], by=[by], out="_k").where(F.col("_k") <= n)
    place: Column = F.col(by)
    if by_order is not None:
        place = F.array_position(F.array(*[F.lit(v) for v in by_order]), F.col(by))
    kept = greedy_distinct(
        drawn.withColumn("_place", place), ["_place", "_k"], keys=(gene, variant)
    )
    return kept.drop("_h", "_k", "_place", "_rank")


def order_factors(theta_a: Sequence[float], theta_b: Sequence[float], min_share: float = 0.025):
    """Indices of the factors by descending expected inclusion, above the share."""
    a, b = np.asarray(theta_a, dtype=float), np.asarray(theta_b, dtype=float)
    share = a / (a + b)
    order = np.argsort(-share, kind="stable")
    return [int(k) for k in order if share[k] > min_share]


def top_tests_by_factor(
    weights: DataFrame,
    n: int,
    *,
    effects: DataFrame | None = None,
    keys: Sequence[str] = ("gene_id", "variant_id"),
    column: str = "v",
) -> DataFrame:
    """The tests with the ``n`` largest absolute weights of each factor, ties kept, with
    their effects by tissue.

    The n-th largest weight of every factor comes from ranks over a range partition, one number
    for each factor; whatever ``n`` is, no factor's tests are sorted in one task.
    """
    long = weights.select(*keys, F.posexplode(column).alias("factor", "weight"))
    long = cut_lineage(long.where(F.col("weight").isNotNull()).withColumn("_size", -F.abs("weight")))
    last = (
        tie_ranks(long, "_size", by=["factor"])
        .where(F.col("lo") <= n)
        .groupBy("factor")
        .agg(F.max("_size").alias("_last"))
    )
    top = long.join(broadcast_if_small(last, width=2), "factor").where(F.col("_size") <= F.col("_last"))
    top = top.select(*keys, "factor", "weight")
    return top if effects is None else top.join(effects, list(keys))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of tables with the same columns."""
    for other in others:
        first = first.unionByName(other)
    return first


def distinct_tests(
    results: DataFrame, keys: Sequence[str] = ("gene_id", "variant_id")
) -> DataFrame:
    """Each test once."""
    return results.select(*keys).distinct()


def intersect_tests(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("gene_id", "variant_id")
) -> DataFrame:
    """Tests of both result sets."""
    return a.select(*keys).intersect(b.select(*keys))


def same_tests(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("gene_id", "variant_id")) -> bool:
    """Whether both result sets hold exactly the same tests."""
    one, two = a.select(*keys), b.select(*keys)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct categories with their zero-based place in sorted order."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked(levels, [column], out="place").withColumn("place", F.col("place") - 1)


def one_hot(df: DataFrame, column: str, levels: Sequence, *, drop_last: bool = True) -> DataFrame:
    """Indicator columns of the levels, the last one dropped by default."""
    shown = levels[:-1] if drop_last else levels
    return df.withColumns(
        {f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in shown}
    )


def add_intercept(df: DataFrame, column: str = "intercept") -> DataFrame:
    """A column of ones in front of the others."""
    return df.select(F.lit(1.0).alias(column), *df.columns)
