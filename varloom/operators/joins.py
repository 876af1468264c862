"""Range joins, keyed alignments and result comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import correlation, neg_log10
from varloom.plans.scale import (
    block_of,
    broadcast_if_small,
    cut_lineage,
    dealt,
    fits_broadcast,
    ranked,
)

def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def unique_genes(genes: DataFrame, *, gene: str = "gene_id", order: str = "ordinal") -> DataFrame:
    """One position per gene: the first annotation row wins, and a gene with a later row
    that differs in both chromosome and TSS is dropped."""
    first = genes.groupBy(gene).agg(
        F.min_by(F.struct(*[c for c in genes.columns if c != gene]), order).alias("_f")
    )
    clash = (
        genes.join(first, gene)
        .where((F.col("chrom") != F.col("_f.chrom")) & (F.col("gene_tss") != F.col("_f.gene_tss")))
        .select(gene)
    )
    return first.join(clash, gene, "left_anti").select(gene, "_f.*")


def cis_pairs(
    genes: DataFrame,
    variants: DataFrame,
    distance: int,
    *,
    gene: str = "gene_id",
    tss: str = "gene_tss",
    variant: str = "variant_id",
    pos: str = "pos",
    chrom: str = "chrom",
) -> DataFrame:
    """Range join: variants within ``distance`` of a gene start, both ends included.

    Positions are cut in bins as wide as the distance. A variant lies in one bin and a gene
    window touches at most three, so the equi-join on (chrom, bin) makes no duplicates.
    """
    width = max(distance, 1)
    left = genes.select(gene, chrom, F.col(tss).alias("gene_tss")).withColumn(
        "_bin", _bins(F.col("gene_tss") - distance, F.col("gene_tss") + distance, width)
    )
    right = variants.select(variant, chrom, F.col(pos).alias("variant_pos")).withColumn(
        "_bin", F.floor(F.col("variant_pos") / width)
    )
    return (
        left.join(right, [chrom, "_bin"])
        .where(F.abs(F.col("variant_pos") - F.col("gene_tss")) <= distance)
        .select(gene, variant, chrom, "gene_tss", "variant_pos")
    )


def map_sites_to_genes(
    sites: DataFrame,
    exons: DataFrame,
    *,
    bin_width: int = 10_000,
    site: str = "site_id",
    chrom: str = "chrom",
    pos: str = "pos",
    start: str = "start_pos",
    end: str = "end_pos",
    gene: str = "gene_id",
) -> DataFrame:
    """Interval join: the gene whose exons hold the site, missing when none or several do."""
    left = sites.select(site, chrom, pos).withColumn("_bin", F.floor(F.col(pos) / bin_width))
    right = exons.select(chrom, start, end, F.col(gene).alias("_gene")).withColumn(
        "_bin", _bins(F.col(start), F.col(end), bin_width)
    )
    hits = (
        left.join(right, [chrom, "_bin"])
        .where(F.col(pos).between(F.col(start), F.col(end)))
        .groupBy(site)
        .agg(F.min("_gene").alias("_lo"), F.max("_gene").alias("_hi"))
    )
    # one distinct gene exactly when the smallest and the largest agree
    named = hits.select(site, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(gene))
    return sites.drop(gene).join(named, site, "left")


def attach_expression(pairs: DataFrame, expr: DataFrame, *, gene: str = "gene_id") -> DataFrame:
    """Expression of the gene of every test; tests of unknown genes are skipped."""
    return pairs.join(expr, gene)


def expand_genotype_to_cells(
    pairs: DataFrame,
    genotype: DataFrame,
    cells: DataFrame,
    *,
    variant: str = "variant_id",
    individual: str = "individual_id",
    cell: str = "cell_id",
    dosage: str = "dosage",
    also: Sequence[str] = (),
) -> DataFrame:
    """Dosage of the donor repeated for each of the donor's cells, beside the columns ``also`` of
    the cell. Where sums over cells are needed and not the rows, use ``cell_genotype``."""
    return cell_genotype(
        pairs, genotype, cells, variant=variant, individual=individual, cell=cell, dosage=dosage
    ).expand(also)


def attach_genotype_bulk(
    samples: DataFrame,
    genotype: DataFrame,
    *,
    missing: str = "zero",
    sample: str = "sample_id",
    variant: str = "variant_id",
    individual: str = "individual_id",
    dosage: str = "dosage",
) -> DataFrame:
    """Dosage for ``individual:tissue`` samples; a missing genotype stays zero by default."""
    donors = samples.select(sample).withColumn(individual, F.split(sample, ":")[0])
    keyed = genotype.withColumn(individual, F.col(individual).cast("string"))
    out = donors.join(keyed.select(variant, individual, dosage), individual)
    if missing == "zero":
        out = out.withColumn(dosage, F.coalesce(dosage, F.lit(0.0)))
    return out.select(variant, sample, dosage)


def annotate_samples(
    samples: DataFrame, *dims: tuple[DataFrame, Sequence[str]]
) -> DataFrame:
    """Left-join any number of annotation tables; a sample without annotation gets NULLs."""
    out = samples
    for dim, keys in dims:
        out = out.join(broadcast_if_small(dim), list(keys), "left")
    return out


def append_cell_covariates(
    cells: DataFrame, extra: DataFrame, *, key: str = "cell_id", strict: bool = False
) -> DataFrame:
    """Add columns by key; ``strict`` raises when a cell has no row in ``extra``."""
    if strict and not cells.join(extra, key, "left_anti").isEmpty():
        raise ValueError(f"rows without a match on {key}")
    return cells.join(extra, key)


def join_het_sites(
    ase: DataFrame,
    het: DataFrame,
    *,
    min_het: int = 3,
    site: str = "site_id",
    individual: str = "individual_id",
    total: str = "total_count",
) -> DataFrame:
    """Counts of heterozygous donors at sites with enough heterozygous donors."""
    enough = het.groupBy(site).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_het)
    usable = het.join(enough.select(site), site, "left_semi").select(site, individual)
    return ase.where(F.col(total) > 0).join(usable, [site, individual], "left_semi")


def genes_in_all(expr: DataFrame, by: str, *, gene: str = "gene_id") -> DataFrame:
    """Genes present in every tissue (relational division)."""
    everywhere = expr.agg(F.count_distinct(by)).scalar()
    per_gene = expr.groupBy(gene).agg(F.count_distinct(by).alias("_n"))
    return per_gene.where(F.col("_n") == everywhere).select(gene)


def compare_results(
    a: DataFrame,
    b: DataFrame,
    *,
    keys: Sequence[str] = ("gene_id", "variant_id"),
    beta: str = "beta",
    pvalue: str = "pvalue",
    also: Sequence[str] = (),
) -> DataFrame:
    """Pearson correlation of effects, of -log10 p-values and of further columns (pseudo R
    squared, say) over the shared tests."""

    def side(table: DataFrame, tag: str) -> DataFrame:
        more = [F.col(c).alias(f"{c}_{tag}") for c in also]
        return table.select(
            *keys, F.col(beta).alias(f"b{tag}"), neg_log10(pvalue).alias(f"p{tag}"), *more
        )

    return side(a, "1").join(side(b, "2"), list(keys)).agg(
        F.count("*").alias("n_tests"),
        correlation("b1", "b2").alias("r_beta"),
        correlation("p1", "p2").alias("r_logp"),
        *[correlation(f"{c}_1", f"{c}_2").alias(f"r_{c}") for c in also],
    )


def effect_size_matrix(
    tests: DataFrame,
    effects: DataFrame,
    *,
    tissues: Sequence[str],
    tissue: str = "tissue",
    gene: str = "gene_id",
    variant: str = "variant_id",
    slope: str = "slope",
) -> DataFrame:
    """Effect of every listed test in every tissue, NULL where it was not tested."""
    pairs = tests.select(gene, variant).distinct()
    return (
        pairs.join(effects.select(gene, variant, tissue, slope), [gene, variant], "left")
        .groupBy(gene, variant)
        .pivot(tissue, list(tissues))
        .agg(F.first(slope, ignorenulls=True))
    )


def ancestry_contrast(
    effects: DataFrame,
    factor: DataFrame,
    *,
    keys: Sequence[str] = ("gene_id", "variant_id"),
    tissue: str = "tissue",
    first: str = "ea_slope",
    second: str = "aa_slope",
    weight: str = "factor",
) -> DataFrame:
    """Per test: median over tissues of the absolute ancestry difference, the absolute factor
    weight, and whether the test is missing in one ancestry everywhere."""
    gap = F.abs(F.col(first) - F.col(second))
    # the group of a test holds at most one row for each tissue
    per_test = effects.groupBy(*keys).agg(
        F.percentile(gap, F.lit(0.5)).alias("median_gap"),
        (F.count(first) > 0).alias("in_first"),
        (F.count(second) > 0).alias("in_second"),
    )
    return factor.select(*keys, F.abs(F.col(weight)).alias("abs_factor")).join(
        per_test, list(keys), "left"
    ).withColumn(
        "missing", ~(F.coalesce("in_first", F.lit(False)) & F.coalesce("in_second", F.lit(False)))
    )


def tissue_contrast(
    effects: DataFrame,
    factor: DataFrame,
    *,
    keys: Sequence[str] = ("gene_id", "variant_id"),
    tissue: str = "tissue",
    first: str = "ea_slope",
    second: str = "aa_slope",
    weight: str = "factor",
) -> DataFrame:
    """Per tissue: correlation of the absolute ancestry difference with the factor weight."""
    gap = F.abs(F.col(first) - F.col(second))
    return (
        effects.join(factor.select(*keys, weight), list(keys))
        .groupBy(tissue)
        .agg(correlation(gap, F.abs(F.col(weight))).alias("r"), F.count(gap).alias("n_tests"))
    )


def assemble_covariates(
    expression_pcs: DataFrame,
    genotype_pcs: DataFrame,
    n: int,
    *,
    sample: str = "sample_id",
    individual: str = "individual_id",
    pcs: str = "pcs",
    n_genotype: int = 5,
) -> DataFrame:
    """Expression components beside genotype components of the donor.

    Donors whose genotype components differ between tissues are an error.
    """
    donors = genotype_pcs.select(individual, F.slice(pcs, 1, n_genotype).alias("_g"))
    agreed = donors.groupBy(individual).agg(
        F.first("_g").alias("_g"), F.count_distinct("_g").alias("_n")
    )
    if not agreed.where(F.col("_n") > 1).isEmpty():
        raise ValueError("genotype components of a donor differ between samples")
    return expression_pcs.join(agreed, individual).select(
        sample, individual, F.concat(F.slice(pcs, 1, n), F.col("_g")).alias("covariates")
    )


def standardized_donor_genotype(
    pairs: DataFrame,
    genotype: DataFrame,
    cells: DataFrame,
    *,
    variant: str = "variant_id",
    individual: str = "individual_id",
    dosage: str = "dosage",
) -> DataFrame:
    """Genotype of every donor, standardised over cells: donors weigh by their cell number."""
    sizes = cells.groupBy(individual).agg(F.count("*").cast("double").alias("_w"))
    needed = genotype.join(pairs.select(variant).distinct(), variant, "left_semi").where(
        F.col(dosage).isNotNull()
    )
    weighted = needed.join(sizes, individual)
    w, g = F.col("_w"), F.col(dosage)
    means = weighted.groupBy(variant).agg((F.sum(w * g) / F.sum(w)).alias("_mean"))
    spread = (
        weighted.join(means, variant)
        .groupBy(variant, "_mean")
        .agg(F.sqrt(F.sum(w * (g - F.col("_mean")) ** 2) / F.sum(w)).alias("_sd"))
    )
    return needed.join(spread, variant).select(
        variant,
        individual,
        F.when(F.col("_sd") > 0, (g - F.col("_mean")) / F.col("_sd")).alias(dosage),
    )


@dataclass
class CellGenotype:
    """Genotypes of cells as two tables: dosages by donor, and the cells of each donor.

    What a consumer needs of all cells x variants is computed from these; the product of the
    two is made by ``expand`` alone.
    """

    donors: DataFrame  # variant, individual, dosage
    cells: DataFrame  # cell, individual, and what else describes a cell
    variant: str = "variant_id"
    individual: str = "individual_id"
    cell: str = "cell_id"
    dosage: str = "dosage"

    def summary(self, by: Sequence[str] = ()) -> DataFrame:
        """Per variant, and per group of cells, the cells, those with a dosage, and the sum,
        mean, sum of squares, minimum and maximum of their dosages."""
        sizes = self.cells.groupBy(self.individual, *by).agg(F.count("*").alias("_w"))
        rows = self.donors.join(broadcast_if_small(sizes, width=2 + len(by)), self.individual)
        w, g = F.col("_w"), F.col(self.dosage)
        called = F.sum(F.when(g.isNotNull(), w).otherwise(0))
        return rows.groupBy(self.variant, *by).agg(
            F.sum(w).alias("n_cells"),
            called.alias("n_called"),
            F.sum(w * g).alias("total"),
            (F.sum(w * g) / F.when(called > 0, called)).alias("mean"),
            F.sum(w * g * g).alias("squares"),
            F.min(g).alias("lowest"),
            F.max(g).alias("highest"),
        )

    def products(self, values: DataFrame, pairs: DataFrame, *, feature: str = "gene_id", value: str = "value") -> DataFrame:
        """Per (feature, variant) pair the sum over cells of value times dosage.

        Stored values of a feature are first summed by donor, so that a pair costs one row per
        donor; absent values are zeros.
        """
        own = values.join(self.cells.select(self.cell, self.individual), self.cell)
        bulk = own.groupBy(feature, self.individual).agg(F.sum(value).alias("_v"))
        wanted = pairs.select(feature, self.variant).distinct()
        rows = wanted.join(bulk, feature).join(self.donors, [self.variant, self.individual])
        return rows.groupBy(feature, self.variant).agg(F.sum(F.col("_v") * F.col(self.dosage)).alias("product"))

    def expand(self, also: Sequence[str] = ()) -> DataFrame:
        """One row for every cell and variant of its donor, with the columns ``also`` of the cell.

        The cells of a donor, and its variants, are packed in blocks, and only blocks are joined: a
        pair of them becomes rows in its task, variant by variant, so that all but the cell stays
        equal over long runs. The rows are not moved; a later join on cells would shuffle cells
        times variants.
        """
        cells = cut_lineage(self.cells.select(self.cell, self.individual, *also))
        least = 4 * cells.sparkSession.sparkContext.defaultParallelism
        # NULL cells stay, as fields of a structure
        listed = F.transform(F.collect_list(F.struct(self.cell)), lambda x: x[self.cell])
        keys = [self.individual, *also, block_of(cells, self.cell, least=least).alias("_block")]
        mine = cells.groupBy(*keys).agg(listed.alias("_cells")).drop("_block")
        donors = cut_lineage(self.donors)
        listed = F.collect_list(F.struct(self.variant, self.dosage)).alias("_variants")
        called = donors.groupBy(self.individual, block_of(donors, self.variant).alias("_block")).agg(listed)
        small = fits_broadcast(donors, (64 << 20) // 40)  # bytes of a variant and a dosage in a block
        called = called.select(self.individual, "_variants")
        rows = dealt(mine).join(F.broadcast(called) if small else called, self.individual)
        rows = rows.select(self.individual, *also, "_cells", F.inline("_variants"))
        return rows.select(self.individual, F.explode("_cells").alias(self.cell), *also, self.variant, self.dosage)


def cell_genotype(
    pairs: DataFrame,
    genotype: DataFrame,
    cells: DataFrame,
    *,
    standardize: bool = False,
    variant: str = "variant_id",
    individual: str = "individual_id",
    cell: str = "cell_id",
    dosage: str = "dosage",
) -> CellGenotype:
    """The genotypes of all cells at the variants of ``pairs``, as they are or standardised over
    the cells, without a row for each cell and variant."""
    if standardize:
        donors = standardized_donor_genotype(
            pairs, genotype, cells, variant=variant, individual=individual, dosage=dosage
        )
    else:
        wanted = pairs.select(variant).distinct()
        donors = genotype.join(wanted, variant, "left_semi").select(variant, individual, dosage)
    return CellGenotype(donors, cells, variant, individual, cell, dosage)


def standardized_genotype(
    pairs: DataFrame,
    genotype: DataFrame,
    cells: DataFrame,
    *,
    variant: str = "variant_id",
    individual: str = "individual_id",
    cell: str = "cell_id",
    dosage: str = "dosage",
    digits: int | None = None,
) -> DataFrame:
    """Genotype of every cell, standardised over cells, one row for each cell and variant.

    The moments come from the donor table weighted by cell counts. Where sums over cells are
    needed and not the rows, use ``cell_genotype``. With ``digits`` the values are rounded, once
    for each donor and variant and not for each cell.
    """
    found = cell_genotype(
        pairs, genotype, cells, standardize=True, variant=variant, individual=individual, cell=cell, dosage=dosage
    )
    if digits is not None:
        found = replace(found, donors=found.donors.withColumn(dosage, F.round(dosage, digits)))
    return found.expand()


def index_labels(
    df: DataFrame, column: str, *, out: str = "label_index", first_seen: Sequence[str] = ()
) -> DataFrame:
    """Zero-based integer of each label; a NULL label has a NULL index.

    Labels count in sorted order or, with ``first_seen``, in the order of their first rows by
    these columns, such as those of ``sources.text.with_position``. Labels whose first rows are
    equal there follow each other in sorted order.
    """
    known = df.where(F.col(column).isNotNull())
    if first_seen:
        place = F.min(F.struct(*first_seen)).alias("_first")
        table = ranked(known.groupBy(column).agg(place), ["_first", column], out=out).drop("_first")
    else:
        table = ranked(known.select(column).distinct(), [column], out=out)
    table = table.withColumn(out, (F.col(out) - 1).cast("int"))
    return df.join(table, column, "left").select(*df.columns, out)
