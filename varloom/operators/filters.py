"""Filters on cells, genes, genotypes, allele counts and test results.

In ``counts`` an absent row means a count of zero; in allele-count tables it means
"not observed". Thresholds on groups are partial aggregates followed by a semi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import is_monoallelic, minor_count
from varloom.plans.scale import broadcast_if_small, hash_order, ranked

# fixed values: the autosomes kept and the gene classes kept
AUTOSOMES = tuple(range(1, 23))
KEPT_TYPE, KEPT_STATUS = "protein_coding", "KNOWN"


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Keep the rows of the groups whose aggregate satisfies ``condition``."""
    passing = (
        df.groupBy(*keys).agg(condition.alias("_keep")).where(F.col("_keep")).select(*keys)
    )
    return df.join(passing, list(keys), "left_semi")


def filter_cells(
    counts: DataFrame, min_genes: int, *, cell: str = "cell_id", value: str = "count"
) -> DataFrame:
    """Cells that express at least ``min_genes`` genes."""
    return keep_groups(counts, [cell], F.count_if(F.col(value) > 0) >= min_genes)


def filter_genes(
    counts: DataFrame,
    min_cells: int | None = None,
    *,
    min_fraction: float | None = None,
    n_cells: int | None = None,
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "count",
) -> DataFrame:
    """Genes seen in at least ``min_cells`` cells, or in a fraction of all cells."""
    if min_fraction is not None:
        total = n_cells if n_cells is not None else counts.select(cell).distinct().count()
        min_cells = min_fraction * total
    return keep_groups(counts, [gene], F.count_if(F.col(value) > 0) >= min_cells)


def qc_metrics(
    counts: DataFrame,
    *,
    mito_prefix: str = "MT-",
    cell: str = "cell_id",
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Per cell: genes expressed, total counts, share of counts in mitochondrial genes."""
    mito = F.sum(F.when(F.col(gene).startswith(mito_prefix), F.col(value)).otherwise(0.0))
    total = F.sum(value)
    return counts.groupBy(cell).agg(
        F.count_if(F.col(value) > 0).alias("n_genes"),
        total.alias("n_counts"),
        F.when(total != 0, mito / total).alias("percent_mito"),
    )


def qc_cells(
    counts: DataFrame,
    *,
    max_genes: int = 2500,
    max_mito: float = 0.05,
    mito_prefix: str = "MT-",
    cell: str = "cell_id",
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Rows of the cells below the gene-number and mitochondrial-share limits."""
    metrics = qc_metrics(counts, mito_prefix=mito_prefix, cell=cell, gene=gene, value=value)
    good = metrics.where((F.col("n_genes") < max_genes) & (F.col("percent_mito") < max_mito))
    return counts.join(good.select(cell), cell, "left_semi")


def filter_gene_type(
    genes: DataFrame,
    *,
    gene_type: str = KEPT_TYPE,
    status: str | None = KEPT_STATUS,
    chroms: Sequence[int] | None = AUTOSOMES,
) -> DataFrame:
    """Known protein-coding genes on autosomes."""
    kept = genes.where(F.col("gene_type") == gene_type)
    if status is not None:
        kept = kept.where(F.col("gene_status") == status)
    return kept if chroms is None else kept.where(F.col("chrom").isin(list(chroms)))


def filter_to_gene_set(counts: DataFrame, genes: DataFrame, *, gene: str = "gene_id") -> DataFrame:
    """Counts of the listed genes."""
    return counts.join(genes.select(gene).distinct(), gene, "left_semi")


def filter_category(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one disease, cell type, day or other category."""
    return df.where(F.col(column) == value)


def filter_genotyped_cells(
    cells: DataFrame, genotype: DataFrame, *, individual: str = "individual_id"
) -> DataFrame:
    """Cells whose donor has genotypes."""
    donors = genotype.select(individual).distinct()
    return cells.join(donors, individual, "left_semi")


def filter_maf(
    genotype: DataFrame,
    min_maf: float = 0.05,
    *,
    variant: str = "variant_id",
    dosage: str = "dosage",
) -> DataFrame:
    """Variants with a minor allele frequency of at least ``min_maf``."""
    af = F.sum(dosage) / (2 * F.count(dosage))
    return keep_groups(genotype, [variant], F.least(af, 1 - af) >= min_maf)


def filter_complete_variants(
    genotype: DataFrame, *, variant: str = "variant_id", dosage: str = "dosage"
) -> DataFrame:
    """Variants without a missing genotype."""
    return keep_groups(genotype, [variant], F.count_if(F.col(dosage).isNull()) == 0)


def filter_ase_sites(
    ase: DataFrame,
    *,
    min_samples: int | None = None,
    min_fraction: float | None = None,
    n_samples: int | None = None,
    max_monoallelic: float = 0.5,
    site: str = "site_id",
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Sites observed in enough samples and not too often monoallelic.

    ``min_fraction`` is a share of all samples (``n_samples``, or those in the table).
    """
    if min_fraction is not None:
        everyone = n_samples if n_samples is not None else ase.select(sample).distinct().count()
        min_samples = min_fraction * everyone
    mono = F.avg(F.when(is_monoallelic(alt, total), 1.0).otherwise(0.0))
    return keep_groups(
        ase, [site], (F.count("*") >= (min_samples or 1)) & (mono <= max_monoallelic)
    )


def filter_nonzero_cells(
    ase: DataFrame, min_reads: int = 5, *, sample: str = "sample_id", total: str = "total_count"
) -> DataFrame:
    """Cells with a site of at least ``min_reads`` reads."""
    return keep_groups(ase, [sample], F.count_if(F.col(total) >= min_reads) > 0)


def filter_high_biallelic(
    ase: DataFrame,
    *,
    min_sites: int = 50,
    min_fraction: float = 0.85,
    min_reads: int = 10,
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Cells with enough biallelic sites and a high biallelic share of expressed sites."""
    expressed = F.count_if(F.col(total) >= min_reads)
    both = F.count_if((F.col(total) >= min_reads) & (minor_count(alt, total) > 0))
    return keep_groups(ase, [sample], (both >= min_sites) & (both / expressed > min_fraction))


def remove_outlier_genes(
    ase: DataFrame,
    *,
    low: float = 0.1,
    high: float = 0.9,
    gene: str = "gene_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Drop genes whose extreme allelic ratios make up more than half of the observed ones."""
    ratio = F.col(alt) / F.col(total)
    extreme = F.count_if(ratio < low) + F.count_if(ratio > high)
    return keep_groups(ase, [gene], 2 * extreme <= F.count("*"))


def mask_low_depth(ase: DataFrame, min_total: int, *, total: str = "total_count") -> DataFrame:
    """Entries below the depth become missing, which is an absent row."""
    return ase.where(F.col(total) >= min_total)


def remove_zero_genes(expr: DataFrame, *, gene: str = "gene_id", value: str = "value") -> DataFrame:
    """Drop genes whose values sum to zero."""
    return keep_groups(expr, [gene], F.sum(value) != 0)


def select_covariates(cov: DataFrame, n: int, *, column: str = "c") -> DataFrame:
    """Keep the first ``n`` entries of the covariate array."""
    return cov.withColumn(column, F.slice(column, 1, n))


def sample_cells(
    cells: DataFrame, fraction: float, seed: int = 0, *, cell: str = "cell_id", exact: bool = True
) -> DataFrame:
    """A random subset without replacement: exactly ``floor(N * fraction)`` cells in hash
    order, or one draw for each cell: it is kept if the first 52 bits of its hash, as a share
    of all such numbers, are below the fraction."""
    if not exact:
        share = F.conv(F.substring(hash_order(seed, cell), 1, 13), 16, 10).cast("double") / 2**52
        return cells.where(share < fraction)
    keyed = cells.select(cell).distinct().withColumn("_h", hash_order(seed, cell))
    order = ranked(keyed, ["_h", cell], out="_rank")
    total = keyed.agg(F.count("*")).scalar()
    chosen = order.where(F.col("_rank") <= F.floor(total * F.lit(fraction)))
    return cells.join(chosen.select(cell), cell, "left_semi")


def filter_significant(
    tests: DataFrame,
    max_p: float,
    *,
    expressed: DataFrame | None = None,
    skip_prefix: str | None = "HLA",
    group: str = "cell_type",
    group_order: Sequence[str] | None = None,
    gene: str = "gene_id",
    variant: str = "variant_id",
    pvalue: str = "pvalue",
) -> DataFrame:
    """Nominally significant pairs, each once; the first cell type in order wins."""
    kept = tests.where(F.col(pvalue) < max_p)
    if skip_prefix:
        kept = kept.where(~F.col(gene).startswith(skip_prefix))
    if expressed is not None:
        kept = kept.join(expressed.select(gene).distinct(), gene, "left_semi")
    place: Column = F.col(group)
    if group_order is not None:
        place = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col(group))
        kept = kept.where(place > 0)
    best = kept.groupBy(gene, variant).agg(F.min_by(F.struct(*kept.columns), place).alias("_r"))
    return best.select("_r.*")


def filter_gene_set_cells(
    loadings: DataFrame, cells: DataFrame, *, cell: str = "cell_id"
) -> DataFrame:
    """Gene-set loadings of the retained cells."""
    return loadings.join(cells.select(cell).distinct(), cell, "left_semi")


def filter_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in a list; the list is broadcast only if it is small."""
    return df.join(broadcast_if_small(listed.select(*keys).distinct()), list(keys), "left_semi")
