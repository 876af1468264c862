"""Standardisation, binning by rank, multiple-testing rules and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.functions import special
from varloom.operators.aggregates import feature_stats
from varloom.plans.scale import cut_lineage, ranked, tie_ranks, with_group_stats


_RUN = 4096  # ranks opened from one row


def standardize(
    expr: DataFrame,
    *,
    by: Sequence[str] = ("gene_id",),
    value: str = "value",
    ddof: int = 0,
    clip: float | None = None,
) -> DataFrame:
    """(x - mean) / sd within each group; NULL where the sd is zero. A wider key such as
    (gene, day) standardises within the day."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    out = with_group_stats(expr, by, F.avg(value).alias("_m"), sd.alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip)))
        z = F.when(F.col("_s") > 0, z)
    return out.withColumn(value, z).drop("_m", "_s")


def center(
    expr: DataFrame, *, by: Sequence[str] = ("gene_id",), value: str = "value"
) -> DataFrame:
    """Subtract the mean of the group."""
    out = with_group_stats(expr, by, F.avg(value).alias("_m"))
    return out.withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def zero_center(
    corrected: DataFrame,
    raw: DataFrame,
    *,
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "value",
) -> DataFrame:
    """Subtract per gene the mean corrected value of the cells whose raw value is zero.

    ``raw`` holds the non-zero raw values, so a cell without a row there has a zero.
    """
    nonzero = raw.where(F.col(value) != 0).select(gene, cell)
    zeros = corrected.join(nonzero, [gene, cell], "left_anti")
    means = zeros.groupBy(gene).agg(F.avg(value).alias("_m"))
    return (
        corrected.join(means, gene, "left")
        .withColumn(value, F.col(value) - F.col("_m"))
        .drop("_m")
    )


def equal_bins(
    df: DataFrame, value: str, n_bins: int, *, tie: str, out: str = "bin"
) -> DataFrame:
    """Equal-sized bins by rank. With 0-based rank r of N the bin is ceil(r * m / N) - 1,
    and 0 for r = 0; a rank on an edge stays in the lower bin, unlike ``ntile``."""
    order = ranked(df, [value, tie], out="_rank")
    size = df.agg(F.count("*")).scalar()
    last_edge = F.ceil((F.col("_rank") - 1) * n_bins / size) - 1
    return order.withColumn(out, F.greatest(last_edge, F.lit(0)).cast("int")).drop("_rank")


def top_variable_genes(
    expr: DataFrame,
    n: int,
    *,
    n_cells: int,
    gene: str = "gene_id",
    value: str = "value",
    standardized: bool = False,
) -> DataFrame:
    """Genes whose variance is at least the n-th largest; ties are kept.

    With ``standardized`` their values are standardised over all cells, absent ones being zeros
    whose standardised value is in ``zero_value``.
    """
    stats = feature_stats(expr, n_cells, gene=gene, value=value).select(gene, "variance")
    # the n-th largest is found among the genes at rank n of the distinct variances
    levels = tie_ranks(stats.withColumn("_neg", -F.col("variance")), "_neg")
    cut = levels.where(F.col("lo") <= n).agg(F.max("_neg")).scalar()
    kept = stats.where(-F.col("variance") <= cut)
    top = expr.join(kept.select(gene, "variance"), gene)
    return standardize_sparse(top, n_cells, by=[gene], value=value) if standardized else top


def gene_level_fdr(
    leads: DataFrame,
    *,
    pvalue: str = "pvalue",
    count: str = "num_snps_in_gene",
    tie: str = "gene_id",
) -> DataFrame:
    """Bonferroni p-value of each gene and n * p / k in ascending order."""
    adjusted = leads.withColumn("bf_pvalue", F.least(F.lit(1.0), F.col(pvalue) * F.col(count)))
    order = ranked(adjusted, ["bf_pvalue", tie], out="k")
    total = leads.agg(F.count("*")).scalar()
    return order.withColumn("fdr", total * F.col("bf_pvalue") / F.col("k"))


def bh_fdr(
    leads: DataFrame,
    threshold: float,
    *,
    pvalue: str = "pvalue",
    count: str = "num_snps_in_gene",
    tie: str = "gene_id",
) -> DataFrame:
    """Genes in ascending order up to the first whose fdr exceeds the threshold.

    This is a prefix rule: a later gene below the threshold stays out.
    """
    table = gene_level_fdr(leads, pvalue=pvalue, count=count, tie=tie)
    stop = table.where(F.col("fdr") > threshold).agg(F.min("k")).scalar()
    return table.where(stop.isNull() | (F.col("k") < stop))


def top_genes(
    leads: DataFrame,
    n: int,
    *,
    pvalue: str = "pvalue",
    count: str = "num_snps_in_gene",
    tie: str = "gene_id",
) -> DataFrame:
    """The first ``n`` genes of the same table."""
    return gene_level_fdr(leads, pvalue=pvalue, count=count, tie=tie).where(F.col("k") <= n)


def _absent(expr: DataFrame, group: str, each: Column) -> DataFrame:
    """How many of the ``each`` rows that every group has are not stored."""
    return expr.groupBy(group).agg(F.count("*").alias("_n")).select(group, (each - F.col("_n")).alias("n"))


def quantile_normalize(
    expr: DataFrame,
    *,
    feature: str = "gene_id",
    sample: str = "sample_id",
    value: str = "value",
    zero_value: bool = False,
) -> DataFrame:
    """Every sample gets the mean distribution over samples; ties get the median of theirs.

    A sample has a value of every feature of the table: those without a row are zeros, which
    are counted in the ranks but not written out. ``zero_value`` adds a column with what a
    zero of the sample becomes, NULL where it has none.

    The rank means rise with the rank, so the median over a run of ties is read off at the
    middle of the run: no tie group is ever gathered.
    """
    stored = expr.where(F.col(value).isNotNull())
    n_features = stored.agg(F.count_distinct(feature)).scalar()
    absent = _absent(stored, sample, n_features)
    ties = cut_lineage(tie_ranks(stored, value, by=[sample], absent=absent))
    n_samples = stored.agg(F.count_distinct(sample)).scalar()
    # a long run of ties is cut in pieces that are spread over the tasks before they open;
    # zeros add nothing to the sums, so their runs stay closed
    step = F.lit(_RUN)
    runs = ties.where(F.col(value) != 0)
    pieces = runs.select(value, "hi", F.explode(F.sequence("lo", "hi", step)).alias("_from"))
    pieces = pieces.repartition(value, "_from")
    per_rank = pieces.select(
        value,
        F.explode(F.sequence("_from", F.least(F.col("_from") + step - 1, F.col("hi")))).alias("_rank"),
    )
    means = (
        per_rank.groupBy("_rank")
        .agg(F.sum(value).alias("_sum"))
        .select("_rank", (F.col("_sum") / n_samples).alias("_q"))
    )
    middle = ties.select(
        sample,
        value,
        F.floor((F.col("lo") + F.col("hi")) / 2).alias("_r1"),
        F.ceil((F.col("lo") + F.col("hi")) / 2).alias("_r2"),
    )
    first = means.select(F.col("_rank").alias("_r1"), F.col("_q").alias("_q1"))
    second = means.select(F.col("_rank").alias("_r2"), F.col("_q").alias("_q2"))
    none = F.lit(0.0)  # a rank at which every sample has a zero
    target = (
        middle.join(first, "_r1", "left")
        .join(second, "_r2", "left")
        .select(sample, value, ((F.coalesce("_q1", none) + F.coalesce("_q2", none)) / 2).alias("_new"))
    )
    out = stored.join(target, [sample, value]).drop(value).withColumnRenamed("_new", value)
    if not zero_value:
        return out.select(*expr.columns)
    zeros = target.where(F.col(value) == 0).select(sample, F.col("_new").alias("zero_value"))
    return out.join(zeros, sample, "left").select(*expr.columns, "zero_value")


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(special.normal_quantile(p.to_numpy()))


def rank_fraction(
    expr: DataFrame,
    *,
    feature: str = "gene_id",
    value: str = "value",
    n_samples: int | Column | None = None,
) -> DataFrame:
    """Average-tie rank over (n + 1) within each feature.

    With ``n_samples`` every feature has that many values, those without a row being zeros:
    they are counted in the ranks, and ``zero_fraction`` is the rank fraction of a zero (NULL
    where the feature has none).
    """
    if n_samples is None:
        absent = None
    else:
        each = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
        absent = _absent(expr.where(F.col(value).isNotNull()), feature, each)
    ties = cut_lineage(tie_ranks(expr, value, by=[feature], absent=absent))
    sizes = ties.groupBy(feature).agg(F.sum("n").alias("_n"))
    table = ties.join(sizes, feature).select(
        feature, value, ((F.col("lo") + F.col("hi")) / 2 / (F.col("_n") + 1)).alias("fraction")
    )
    out = expr.join(table, [feature, value])
    if n_samples is None:
        return out
    zeros = table.where(F.col(value) == 0).select(feature, F.col("fraction").alias("zero_fraction"))
    return out.join(zeros, feature, "left")


def inverse_normal(
    expr: DataFrame,
    *,
    feature: str = "gene_id",
    value: str = "value",
    n_samples: int | Column | None = None,
) -> DataFrame:
    """Normal quantile of the rank fraction of each feature; with ``n_samples`` absent rows are
    zeros, and ``zero_value`` is the quantile of a zero."""
    ranks = rank_fraction(expr, feature=feature, value=value, n_samples=n_samples)
    out = ranks.withColumn(value, _normal_quantile("fraction")).drop("fraction")
    if n_samples is None:
        return out
    return out.withColumn("zero_value", _normal_quantile("zero_fraction")).drop("zero_fraction")


def pearson_zero_terms(
    counts: DataFrame, table: DataFrame, *, cell: str = "cell_id", gene: str = "gene_id", value: str = "count"
) -> tuple[DataFrame, DataFrame]:
    """The zeros of ``pearson_residuals`` as terms for ``pca``: (cell, a) and (gene, b) whose
    products sum to the residual of a zero. Genes without spread have NULLs."""
    cells = counts.groupBy(cell).agg(F.sum(value).alias("_N"))
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    return (
        cells.select(cell, F.array(F.sqrt("_N"), F.lit(1.0)).alias("a")),
        table.select(gene, F.array(F.col("zero_slope") / sd, -F.col("mean") / sd).alias("b")),
    )


def log_normalize(
    counts: DataFrame,
    *,
    target: float = 1e4,
    by: Sequence[str] = ("cell_id",),
    value: str = "count",
    out: str = "value",
) -> DataFrame:
    """ln(1 + target * x / total of the sample). Absent rows stay zero."""
    totals = with_group_stats(counts, by, F.sum(value).alias("_t"))
    return totals.withColumn(out, F.log1p(target * F.col(value) / F.col("_t"))).drop("_t")


def log2_tpm(expr: DataFrame, *, value: str = "value") -> DataFrame:
    """log2(x + 1). An absent sample-gene row means zero, whose transform is zero as well."""
    return expr.withColumn(value, F.log2(F.coalesce(value, F.lit(0.0)) + 1))


def standardize_sparse(
    expr: DataFrame,
    n_samples: int | Column,
    *,
    by: Sequence[str] = ("gene_id",),
    value: str = "value",
) -> DataFrame:
    """Standardise a table whose absent rows are zeros.

    ``n_samples`` is the number of samples that every group has, or a column with it. Returns the stored rows standardised, with the standardised zero of the group beside
    them (``zero_value``), so the dense matrix never has to be written out.
    """
    n = F.max(n_samples) if isinstance(n_samples, Column) else F.lit(n_samples)
    mean = F.sum(value) / n
    within = F.var_pop(value) * F.count(value)
    between = F.count(value) * (F.avg(value) - mean) ** 2 + (n - F.count(value)) * mean**2
    out = with_group_stats(
        expr, by, mean.alias("_m"), F.sqrt((within + between) / n).alias("_s")
    )
    positive = F.col("_s") > 0
    return (
        out.withColumn("zero_value", F.when(positive, -F.col("_m") / F.col("_s")))
        .withColumn(value, F.when(positive, (F.col(value) - F.col("_m")) / F.col("_s")))
        .drop("_m", "_s")
    )


def normalize_pseudobulk(
    counts: DataFrame,
    *,
    sample: Sequence[str] = ("sample_id",),
    gene: str = "gene_id",
    value: str = "count",
    within: Sequence[str] = (),
    zeros: bool = False,
) -> DataFrame:
    """Log-normalise each pseudobulk sample, then standardise each gene over samples.

    ``within`` adds a cell type to the standardisation key. With ``zeros`` absent rows count
    as zeros among the samples of their cell type, and ``zero_value`` comes beside the rows.
    """
    logged = log_normalize(counts, by=[*sample, *(c for c in within if c not in sample)], value=value)
    key = [gene, *within]
    if not zeros:
        return standardize(logged, by=key)
    everyone = counts.select(*sample, *(c for c in within if c not in sample)).distinct()
    sizes = everyone.groupBy(*within).agg(F.count("*").alias("_samples"))
    if within:
        sized = logged.join(sizes, list(within))
    else:
        sized = logged.withColumn("_samples", sizes.agg(F.max("_samples")).scalar())
    return standardize_sparse(sized, F.col("_samples"), by=key).drop("_samples")


def pearson_residuals(
    counts: DataFrame, *, cell: str = "cell_id", gene: str = "gene_id", value: str = "count"
) -> tuple[DataFrame, DataFrame]:
    """Pearson residuals of multinomial counts, standardised per gene.

    With cell total N and gene share p the mean is N p and a zero count has the residual
    -sqrt(N) * sqrt(p / (1 - p)). Zeros therefore need no rows: the first table has the
    stored entries, the second gives per gene ``zero_slope``, ``mean`` and ``sd`` so that
    a zero of a cell is (zero_slope * sqrt(N) - mean) / sd.
    """
    by_cell = counts.groupBy(cell).agg(F.sum(value).alias("_N"))
    by_gene = counts.groupBy(gene).agg(F.sum(value).alias("_g"))
    world = by_cell.agg(
        F.struct(
            F.sum("_N").alias("total"),
            F.sum(F.sqrt("_N")).alias("roots"),
            F.count("*").alias("cells"),
        )
    ).scalar()
    share = by_gene.withColumn("_w", world).select(
        gene,
        (F.col("_g") / F.col("_w.total")).alias("_p"),
        F.col("_w.total").alias("_all"),
        F.col("_w.roots").alias("_roots"),
        F.col("_w.cells").alias("_cells"),
    )
    slope = -F.sqrt(F.col("_p") / (1 - F.col("_p")))
    mu = F.col("_N") * F.col("_p")
    entries = (
        counts.where(F.col(value) != 0)
        .join(by_cell, cell)
        .join(share.select(gene, "_p"), gene)
        .withColumn("_r", (F.col(value) - mu) / F.sqrt(mu - mu * mu / F.col("_N")))
        .withColumn("_z", slope * F.sqrt("_N"))
    )
    moments = entries.groupBy(gene).agg(
        F.sum(F.col("_r") - F.col("_z")).alias("_d1"),
        F.sum(F.col("_r") ** 2 - F.col("_z") ** 2).alias("_d2"),
    )
    table = (
        share.join(moments, gene)
        .withColumn("zero_slope", slope)
        .withColumn("mean", (slope * F.col("_roots") + F.col("_d1")) / F.col("_cells"))
        .withColumn("_sq", (slope * slope * F.col("_all") + F.col("_d2")) / F.col("_cells"))
        .withColumn("sd", F.sqrt(F.greatest(F.col("_sq") - F.col("mean") ** 2, F.lit(0.0))))
        .select(gene, "zero_slope", "mean", "sd")
    )
    scaled = entries.join(table.select(gene, "mean", "sd"), gene).select(
        cell,
        gene,
        F.when(F.col("sd") > 0, (F.col("_r") - F.col("mean")) / F.col("sd")).alias("value"),
    )
    return scaled, table


def tmm_factors(
    counts: DataFrame,
    *,
    logratio_trim: float = 0.3,
    sum_trim: float = 0.05,
    sample: str = "sample_id",
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Trimmed mean of M-values for each sample, scaled to a geometric mean of one.

    The reference sample has the upper quartile nearest to the mean upper quartile. Genes
    absent in a sample count as zeros for the quartile and drop out of the ratios.
    """
    stored = counts.where(F.col(value) > 0)
    totals = stored.groupBy(sample).agg(F.sum(value).alias("_N"))
    n_genes = stored.agg(F.count_distinct(gene)).scalar()
    # linear-interpolated 75 % point over all genes, zeros first
    ties = tie_ranks(stored, value, by=[sample])
    stored_n = ties.groupBy(sample).agg(F.sum("n").alias("_stored"))
    place = (F.col("_G") - 1) * 0.75
    zeros = F.col("_G") - F.col("_stored")
    shifted = (
        ties.join(stored_n, sample)
        .withColumn("_G", n_genes)
        .withColumn("_lo", F.col("lo") + zeros - 1)
        .withColumn("_hi", F.col("hi") + zeros - 1)
    )

    def at(position):
        inside = (F.col("_lo") <= position) & (position <= F.col("_hi"))
        return F.coalesce(F.max(F.when(inside, F.col(value))), F.lit(0.0))

    frac = F.max(place - F.floor(place))
    low, high = at(F.floor(place)), at(F.ceil(place))
    quartile = shifted.groupBy(sample).agg((low + (high - low) * frac).alias("_q"))
    f75 = quartile.join(totals, sample).select(
        sample, "_N", (F.col("_q") / F.col("_N")).alias("_f")
    )
    mean = f75.agg(F.avg("_f")).scalar()
    chosen = f75.withColumn("_gap", F.abs(F.col("_f") - mean)).agg(
        F.min_by(sample, F.struct("_gap", sample))
    )
    reference = (
        stored.where(F.col(sample) == chosen.scalar())
        .join(totals, sample)
        .select(gene, F.col(value).alias("_y0"), F.col("_N").alias("_N0"))
    )
    y, n, y0, n0 = (F.col(c) for c in (value, "_N", "_y0", "_N0"))
    rated = stored.join(totals, sample).join(reference, gene).select(
        sample,
        gene,
        F.log2((y / n) / (y0 / n0)).alias("_m"),
        (0.5 * (F.log2(y / n) + F.log2(y0 / n0))).alias("_a"),
        ((n - y) / n / y + (n0 - y0) / n0 / y0).alias("_v"),
    )
    rated = cut_lineage(rated)  # read three times below
    for column, rank in (("_m", "_rm"), ("_a", "_ra")):
        t = tie_ranks(rated, column, by=[sample]).select(
            sample, column, ((F.col("lo") + F.col("hi")) / 2).alias(rank)
        )
        rated = rated.join(t, [sample, column])
    sizes = rated.groupBy(sample).agg(F.count("*").alias("_n"))
    lo_m = F.floor(F.col("_n") * logratio_trim) + 1
    lo_a = F.floor(F.col("_n") * sum_trim) + 1
    kept = rated.join(sizes, sample).where(
        F.col("_rm").between(lo_m, F.col("_n") + 1 - lo_m)
        & F.col("_ra").between(lo_a, F.col("_n") + 1 - lo_a)
    )
    # a zero weight is infinite precision; such entries cancel in numerator and denominator
    raw = kept.where(F.col("_v") > 0).groupBy(sample).agg(
        (F.sum(F.col("_m") / F.col("_v")) / F.sum(1 / F.col("_v"))).alias("_log")
    )
    level = raw.agg(F.avg("_log")).scalar()
    return raw.select(sample, F.pow(F.lit(2.0), F.col("_log") - level).alias("tmm"))


def cpm(
    counts: DataFrame,
    tmm: DataFrame | None = None,
    *,
    sample: str = "sample_id",
    value: str = "count",
) -> DataFrame:
    """Counts per million reads of the sample, on the effective library size with TMM."""
    out = with_group_stats(counts, [sample], F.sum(value).alias("_N"))
    size = F.col("_N")
    if tmm is not None:
        out = out.join(tmm, sample)
        size = size * F.col("tmm")
    return out.withColumn("cpm", F.col(value) / size * 1e6).drop("_N", "tmm")
