"""From raw allele counts to the site-by-cell table that the allelic models read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.allelic import biallelic_summary, one_site_per_gene
from varloom.operators.filters import filter_ase_sites, filter_nonzero_cells
from varloom.operators.joins import map_sites_to_genes
from varloom.plans.scale import cut_lineage


def prepare_allelic_counts(
    ase: DataFrame,
    sites: DataFrame,
    exons: DataFrame,
    *,
    min_fraction: float = 0.3,
    max_monoallelic: float = 0.5,
    min_reads: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Filter sites, keep the deepest site of each gene, drop empty cells.

    Returns the counts and the summary of each cell. ``sites`` has site_id, chrom and pos.
    """
    kept = cut_lineage(
        filter_ase_sites(ase, min_fraction=min_fraction, max_monoallelic=max_monoallelic)
    )
    used = sites.join(kept.select("site_id").distinct(), "site_id", "left_semi")
    named = map_sites_to_genes(used, exons)
    order = named.select("site_id", "gene_id", F.struct("chrom", "pos").alias("place"))
    # the first site on the genome wins ties of depth
    numbered = order.withColumn("ordinal", F.col("place.chrom") * F.lit(10**10) + F.col("place.pos"))
    single = one_site_per_gene(kept, numbered.select("site_id", "gene_id", "ordinal"))
    final = cut_lineage(filter_nonzero_cells(single, min_reads))
    return final, biallelic_summary(final)
