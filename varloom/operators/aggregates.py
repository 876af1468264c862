"""Pseudobulk, feature and genotype statistics, lead variants and compositions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import correlation, sample_label


def pseudobulk(
    counts: DataFrame,
    cells: DataFrame,
    by: Sequence[str],
    *,
    cell: str = "cell_id",
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Raw counts summed over the cells of each (by, gene)."""
    return (
        counts.join(cells.select(cell, *by), cell)
        .groupBy(*by, gene)
        .agg(F.sum(value).alias(value))
    )


def pseudobulk_samples(
    cells: DataFrame, by: Sequence[str], *, population: str = "population"
) -> DataFrame:
    """One row for each pseudobulk sample: id, population and number of cells.

    ``population_ok`` is false where the cells of the sample disagree on the population.
    """
    return (
        cells.groupBy(*by)
        .agg(
            F.min(population).alias(population),
            F.count("*").alias("n_cells"),
            (F.min(population) == F.max(population)).alias("population_ok"),
        )
        .withColumn("sample_id", sample_label(*by))
    )


def feature_stats(
    expr: DataFrame,
    n_cells: int | Column,
    *,
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Per gene: mean, population variance, share of zero cells, total and share expressed.

    Absent rows are zeros, so everything is divided by the number of cells.
    """
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    x = F.col(value)
    stored = F.count(value)
    mean = F.sum(value) / n
    # stored values around their own mean, plus the shift to the mean with zeros
    within = F.var_pop(value) * stored
    between = stored * (F.avg(value) - mean) ** 2 + (n - stored) * mean**2
    return expr.groupBy(gene).agg(
        mean.alias("mean"),
        ((within + between) / n).alias("variance"),
        ((n - F.count_if(x != 0)) / n).alias("fraction_zero"),
        F.sum(value).alias("total"),
        (F.count_if(x > 0) / n).alias("fraction_expressed"),
    )


def maf(
    genotype: DataFrame, *, variant: str = "variant_id", dosage: str = "dosage"
) -> DataFrame:
    """Allele frequency and minor allele frequency of each variant."""
    af = F.sum(dosage) / (2 * F.count(dosage))
    return genotype.groupBy(variant).agg(af.alias("af"), F.least(af, 1 - af).alias("maf"))


def impute_mean(
    genotype: DataFrame, *, variant: str = "variant_id", dosage: str = "dosage"
) -> DataFrame:
    """Missing genotypes become the mean of the observed ones of the variant."""
    means = genotype.groupBy(variant).agg(F.avg(dosage).alias("_mean"))
    return (
        genotype.join(means, variant)
        .withColumn(dosage, F.coalesce(dosage, "_mean"))
        .drop("_mean")
    )


def library_size(
    counts: DataFrame, *, cell: str = "cell_id", value: str = "count"
) -> DataFrame:
    """Total counts of each cell."""
    return counts.groupBy(cell).agg(F.sum(value).alias("library_size"))


def lead_variant(
    tests: DataFrame,
    *,
    by: Sequence[str] = ("gene_id",),
    pvalue: str = "pvalue",
    order: str = "ordinal",
) -> DataFrame:
    """Per gene the test with the smallest p-value, the last one among ties, and the number
    of tests of the gene."""
    row = F.struct(*[c for c in tests.columns if c not in by])
    return (
        tests.groupBy(*by)
        .agg(
            F.min_by(row, F.struct(F.col(pvalue), -F.col(order))).alias("_lead"),
            F.count("*").alias("num_snps_in_gene"),
        )
        .select(*by, "_lead.*", "num_snps_in_gene")
    )


def knn_category_summary(
    knn: DataFrame,
    cells: DataFrame,
    category: str,
    *,
    weighted: bool = False,
    cell: str = "cell_id",
    neighbor: str = "neighbor_id",
) -> DataFrame:
    """For each category of the centre cell, the share of its neighbours by category."""
    edges = knn.select(cell, neighbor, *(["weight"] if weighted else []))
    if weighted:
        totals = edges.groupBy(cell).agg(F.sum("weight").alias("_total"))
        edges = edges.join(totals, cell).withColumn("_w", F.col("weight") / F.col("_total"))
    else:
        edges = edges.withColumn("_w", F.lit(1.0))
    centre = cells.select(F.col(cell), F.col(category).alias("category"))
    other = cells.select(F.col(cell).alias(neighbor), F.col(category).alias("neighbor_category"))
    table = (
        edges.join(centre, cell)
        .join(other, neighbor)
        .groupBy("category", "neighbor_category")
        .agg(F.sum("_w").alias("_w"))
    )
    totals = table.groupBy("category").agg(F.sum("_w").alias("_total"))
    return table.join(totals, "category").select(
        "category", "neighbor_category", (F.col("_w") / F.col("_total")).alias("fraction")
    )


def composition(cells: DataFrame, by: str, category: str) -> DataFrame:
    """Cells of each category in each group, with the proportion of the group."""
    table = cells.groupBy(by, category).agg(F.count("*").alias("n_cells"))
    totals = table.groupBy(by).agg(F.sum("n_cells").alias("_total"))
    return table.join(totals, by).select(
        by, category, "n_cells", (F.col("n_cells") / F.col("_total")).alias("proportion")
    )


def composition_with_zeros(
    cells: DataFrame, by: str, category: str, levels: Sequence
) -> DataFrame:
    """Cell numbers of each group for every listed category, zero where there are none."""
    wide = cells.groupBy(by).agg(
        *[F.count_if(F.col(category) == v).alias(f"_{i}") for i, v in enumerate(levels)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias(category), F.col(f"_{i}").alias("n_cells"))
            for i, v in enumerate(levels)
        ]
    )
    return wide.select(by, F.explode(pairs).alias("_p")).select(by, "_p.*")


def modal_category(cells: DataFrame, by: str, category: str) -> DataFrame:
    """Most frequent category of each group; the smallest label wins ties."""
    table = cells.groupBy(by, category).agg(F.count("*").alias("_n"))
    return table.groupBy(by).agg(
        F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias(category)
    )


def distinct_per_group(cells: DataFrame, by: str, *columns: str) -> DataFrame:
    """Cells and distinct values of the columns in each group."""
    return cells.groupBy(by).agg(
        F.count("*").alias("n_cells"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in columns],
    )


def factor_composition(
    loadings: DataFrame,
    cells: DataFrame,
    category: str,
    *,
    cut: float = 0.5,
    sample: str = "sample_id",
    column: str = "u",
) -> DataFrame:
    """Samples with a loading above the cut, by factor and category."""
    long = loadings.select(sample, F.posexplode(column).alias("factor", "loading"))
    return (
        long.where(F.col("loading") > cut)
        .join(cells.select(sample, category), sample)
        .groupBy("factor", category)
        .agg(F.count("*").alias("n_samples"))
    )


def loading_correlation(
    a: DataFrame, b: DataFrame, *, sample: str = "sample_id", column: str = "u"
) -> DataFrame:
    """Absolute correlation of every factor of one fit with every factor of another."""
    left = a.select(sample, F.posexplode(column).alias("factor_a", "x"))
    right = b.select(sample, F.posexplode(column).alias("factor_b", "y"))
    return (
        left.join(right, sample)
        .groupBy("factor_a", "factor_b")
        .agg(F.abs(correlation("x", "y")).alias("abs_r"))
    )


def covariate_r2(
    loadings: DataFrame,
    covariates: DataFrame,
    *,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    sample: str = "sample_id",
    column: str = "u",
) -> DataFrame:
    """Adjusted R squared of ``loading ~ covariate`` for each factor and covariate."""
    long = loadings.select(sample, F.posexplode(column).alias("factor", "y"))
    parts = []
    if numeric:
        joined = long.join(covariates.select(sample, *numeric), sample)
        stacked = joined.unpivot(
            [sample, "factor", "y"],
            [F.col(c).cast("double").alias(c) for c in numeric],
            "covariate",
            "x",
        )
        stats = stacked.where(F.col("x").isNotNull()).groupBy("factor", "covariate").agg(
            F.regr_r2("y", "x").alias("_r2"), F.count("*").alias("_n"), F.lit(2).alias("_p")
        )
        parts.append(stats)
    if categorical:
        joined = long.join(covariates.select(sample, *categorical), sample)
        stacked = joined.unpivot(
            [sample, "factor", "y"],
            [F.col(c).cast("string").alias(c) for c in categorical],
            "covariate",
            "level",
        ).where(F.col("level").isNotNull())
        levels = stacked.groupBy("factor", "covariate", "level").agg(
            F.count("*").alias("n"),
            F.avg("y").alias("m"),
            (F.var_pop("y") * F.count("*")).alias("within"),
        )
        # weighted mean of the level means is the grand mean
        between = F.sum(F.col("n") * F.col("m") ** 2) - F.sum(
            F.col("n") * F.col("m")
        ) ** 2 / F.sum("n")
        total = between + F.sum("within")
        stats = levels.groupBy("factor", "covariate").agg(
            F.when(total > 0, between / total).alias("_r2"),
            F.sum("n").alias("_n"),
            F.count("*").alias("_p"),
        )
        parts.append(stats)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    n, p = F.col("_n"), F.col("_p")
    adjusted = 1 - (1 - F.col("_r2")) * (n - 1) / F.when(n > p, n - p)
    return both.select("factor", "covariate", adjusted.alias("adj_r2"))


def covariate_pair_r2(
    loadings: DataFrame,
    covariates: DataFrame,
    first: str,
    second: str,
    *,
    numeric: bool = False,
    sample: str = "sample_id",
    column: str = "u",
) -> DataFrame:
    """Adjusted R squared of ``loading ~ first + second`` for each factor. ``first`` is a
    category, ``second`` a category or a number."""
    long = loadings.select(sample, F.posexplode(column).alias("factor", "y"))
    rows = long.join(covariates.select(sample, first, second), sample).dropna()
    n, p = F.col("_n"), F.col("_p")
    if numeric:
        x = F.col(second).cast("double")
        # the slope within levels adds to the sum of squares between levels
        levels = rows.groupBy("factor", first).agg(
            F.count("*").alias("n"),
            F.avg("y").alias("m"),
            (F.var_pop("y") * F.count("*")).alias("yy"),
            (F.var_pop(x) * F.count("*")).alias("xx"),
            (F.covar_pop(x, F.col("y").cast("double")) * F.count("*")).alias("xy"),
        )
        between = F.sum(F.col("n") * F.col("m") ** 2) - F.sum(
            F.col("n") * F.col("m")
        ) ** 2 / F.sum("n")
        slope = F.when(F.sum("xx") > 0, F.sum("xy") ** 2 / F.sum("xx")).otherwise(0.0)
        stats = levels.groupBy("factor").agg(
            ((between + slope) / (between + F.sum("yy"))).alias("_r2"),
            F.sum("n").alias("_n"),
            (F.count("*") + F.when(F.sum("xx") > 0, 1).otherwise(0)).alias("_p"),
        )
    else:
        # one row for each pair of levels
        pairs = rows.groupBy("factor", first, second).agg(
            F.count("*").cast("double").alias("n"),
            F.avg("y").alias("m"),
            (F.var_pop("y") * F.count("*")).alias("yy"),
        )

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            w, m = frame["n"].to_numpy(), frame["m"].to_numpy()
            design = np.column_stack(
                [pd.get_dummies(frame[c]).to_numpy(dtype=float) for c in (first, second)]
            )
            root = np.sqrt(w)[:, None]
            beta, _, rank, _ = np.linalg.lstsq(design * root, m * root[:, 0], rcond=None)
            rest = (w * (m - design @ beta) ** 2).sum() + frame["yy"].sum()
            total = (w * (m - np.average(m, weights=w)) ** 2).sum() + frame["yy"].sum()
            return pd.DataFrame(
                {"factor": frame["factor"].iloc[:1], "_r2": [1 - rest / total],
                 "_n": [int(w.sum())], "_p": [int(rank)]}
            )

        stats = pairs.groupBy("factor").applyInPandas(
            fit, "factor int, _r2 double, _n bigint, _p bigint"
        )
    adjusted = 1 - (1 - F.col("_r2")) * (n - 1) / F.when(n > p, n - p)
    return stats.select("factor", adjusted.alias("adj_r2"))


def egenes_by_group(
    results: DataFrame,
    samples: DataFrame,
    *,
    group: str = "cell_type",
    gene: str = "gene_id",
) -> DataFrame:
    """Significant genes and cells of each cell type."""
    egenes = results.groupBy(group).agg(F.count_distinct(gene).alias("n_egenes"))
    sizes = samples.groupBy(group).agg(F.count("*").alias("n_cells"))
    return sizes.join(egenes, group, "left").fillna(0, ["n_egenes"])


def egene_cell_correlation(table: DataFrame) -> DataFrame:
    """Correlation of gene number with cell number over the groups."""
    return table.agg(
        correlation(F.col("n_cells").cast("double"), F.col("n_egenes").cast("double")).alias("r"),
        F.count("*").alias("n_groups"),
    )
