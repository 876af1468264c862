"""Calling cis effects on expression from counts to corrected genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.aggregates import lead_variant, pseudobulk
from varloom.operators.filters import filter_maf
from varloom.operators.joins import attach_expression, cis_pairs
from varloom.operators.normalize import bh_fdr, log_normalize, standardize_sparse
from varloom.operators.regression import grouped_ols
from varloom.plans.scale import cut_lineage


def cis_rows(
    counts: DataFrame,
    cells: DataFrame,
    genes: DataFrame,
    genotype: DataFrame,
    *,
    distance: int,
    min_maf: float = 0.05,
) -> DataFrame:
    """One row for each (gene, variant, donor): standardised expression and dosage.

    Counts are summed by donor before anything is joined to the pairs, and genotypes stay at
    the level of donors. A donor without a count of a gene has a zero there, in the moments
    and in the rows. Genes without any count have no rows.
    """
    bulk = cut_lineage(pseudobulk(counts, cells, ["individual_id"]))
    donors = bulk.select("individual_id").distinct()
    logged = log_normalize(bulk, by=["individual_id"])
    expression = standardize_sparse(logged, donors.count(), by=["gene_id"])
    expression = cut_lineage(expression.select("individual_id", "gene_id", "value", "zero_value"))
    zeros = expression.groupBy("gene_id").agg(F.first("zero_value").alias("zero_value"))
    common = filter_maf(genotype, min_maf)
    variants = common.select("variant_id", "chrom", "pos").distinct()
    pairs = cis_pairs(genes, variants, distance).select("gene_id", "variant_id")
    called = common.where(F.col("dosage").isNotNull())
    called = called.select("variant_id", "individual_id", "dosage")
    called = called.join(donors, "individual_id", "left_semi")
    rows = attach_expression(pairs, zeros).join(called, "variant_id")
    stored = expression.select("individual_id", "gene_id", "value")
    return rows.join(stored, ["individual_id", "gene_id"], "left").select(
        "gene_id",
        "variant_id",
        "individual_id",
        F.coalesce("value", "zero_value").alias("value"),
        "dosage",
    )


def call_cis_eqtls(
    counts: DataFrame,
    cells: DataFrame,
    genes: DataFrame,
    genotype: DataFrame,
    *,
    distance: int,
    threshold: float,
    min_maf: float = 0.05,
    covariates: DataFrame | None = None,
    covariate_columns: Sequence[str] = (),
) -> DataFrame:
    """Pseudobulk, normalise, pair, regress, take the lead variant of each gene and correct."""
    rows = cis_rows(counts, cells, genes, genotype, distance=distance, min_maf=min_maf)
    if covariates is not None:
        rows = rows.join(covariates, "individual_id")
    tests = grouped_ols(
        rows, ["gene_id", "variant_id"], y="value", x="dosage", covariates=covariate_columns
    ).where(F.col("pvalue").isNotNull())
    # written once: the correction reads the leads more than once
    leads = cut_lineage(lead_variant(tests, order="variant_id"))
    return bh_fdr(leads, threshold)
