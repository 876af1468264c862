"""Allele-count tables: depth, one site per gene, phasing, binning and summaries.

An absent row is a missing observation, never a count of zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import allelic_ratio, capped_depth, minor_count
from varloom.plans.scale import broadcast_if_small, cut_lineage, hash_order, ranked


def site_depth(ase: DataFrame, *, site: str = "site_id", total: str = "total_count") -> DataFrame:
    """Reads of each site over its observed samples."""
    return ase.groupBy(site).agg(F.sum(total).alias("depth"))


def one_site_per_gene(
    ase: DataFrame,
    sites: DataFrame,
    *,
    site: str = "site_id",
    gene: str = "gene_id",
    order: str = "ordinal",
    total: str = "total_count",
) -> DataFrame:
    """Counts of the deepest site of each gene, the first one among ties.

    ``sites`` gives gene and ordinal; sites without a gene form one group.
    """
    depths = site_depth(ase, site=site, total=total).join(sites, site)
    best = depths.groupBy(gene).agg(
        F.max_by(site, F.struct(F.col("depth"), -F.col(order))).alias(site)
    )
    return ase.join(best.select(site), site, "left_semi")


def min_allele(
    ase: DataFrame, *, alt: str = "allele_count", total: str = "total_count"
) -> DataFrame:
    """Replace the allele count by the count of the rarer allele."""
    return ase.withColumn(alt, minor_count(alt, total))


def cap_depth(
    ase: DataFrame, max_total: int, *, alt: str = "allele_count", total: str = "total_count"
) -> DataFrame:
    """Scale entries above the depth down to it."""
    new_alt, new_total = capped_depth(max_total, alt, total)
    return ase.withColumns({alt: new_alt, total: new_total})


def scale_ratios(
    ase: DataFrame,
    *,
    site: str = "site_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Allelic ratio standardised over the observed cells of the site."""
    rated = ase.withColumn("_r", allelic_ratio(alt, total)).where(F.col("_r").isNotNull())
    stats = rated.groupBy(site).agg(
        F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s")
    )
    scaled = F.when(F.col("_s") > 0, (F.col("_r") - F.col("_m")) / F.col("_s"))
    return rated.join(stats, site).withColumn("scaled_ratio", scaled).drop("_r", "_m", "_s")


def regress_out_groups(
    ratios: DataFrame,
    *,
    site: str = "site_id",
    group: str = "individual_id",
    value: str = "scaled_ratio",
    rescale: bool = True,
) -> DataFrame:
    """Residual of the scaled ratio on donor indicators: the donor mean of the site is
    subtracted, and the residual is scaled again over the site."""
    observed = ratios.where(F.col(value).isNotNull())
    means = observed.groupBy(site, group).agg(
        F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count("*").alias("_n")
    )
    out = observed
    spread = means
    if rescale:
        # residual means are zero, so the site variance pools the within-donor variances
        pooled = means.groupBy(site).agg(
            F.sqrt(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_s")
        )
        spread = means.join(pooled, site)
    out = observed.join(spread.drop("_v", "_n"), [site, group])
    residual = F.col(value) - F.col("_m")
    if rescale:
        residual = F.when(F.col("_s") > 1e-12, residual / F.col("_s"))
    return out.withColumn(value, residual).drop("_m", "_s")


def phase_by_individual(
    ase: DataFrame,
    *,
    site: str = "site_id",
    individual: str = "individual_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Phase of the donor at the site: flipped where the alternate allele has the majority."""
    sums = ase.groupBy(site, individual).agg(F.sum(alt).alias("_a"), F.sum(total).alias("_t"))
    phase = (
        F.when(F.col("_t") == 0, "missing")
        .when(2 * F.col("_a") <= F.col("_t"), "correct")
        .otherwise("flipped")
    )
    return sums.select(site, individual, phase.alias("phase"))


def sum_by_bin(
    ase: DataFrame,
    bin_column: str,
    *,
    mode: str = "min",
    site: str = "site_id",
    individual: str = "individual_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Allele and total reads of each (site, bin); no reads give NULL.

    ``min`` sums the rarer allele of every entry, ``raw`` the alternate allele, ``line_min``
    the allele that is rarer over all cells of the donor.
    """
    if mode == "min":
        number: Column = minor_count(alt, total)
    elif mode == "raw":
        number = F.col(alt)
    elif mode == "line_min":
        phases = phase_by_individual(ase, site=site, individual=individual, alt=alt, total=total)
        ase = ase.join(phases, [site, individual])
        number = F.when(F.col("phase") == "flipped", F.col(total) - F.col(alt)).otherwise(
            F.col(alt)
        )
    else:
        raise ValueError(f"unknown mode {mode}")
    sums = ase.groupBy(site, bin_column).agg(F.sum(number).alias("_a"), F.sum(total).alias("_t"))
    seen = F.col("_t") > 0
    return sums.select(
        site,
        bin_column,
        F.when(seen, F.col("_a")).alias(alt),
        F.when(seen, F.col("_t")).alias(total),
    )


def bin_measures(
    binned: DataFrame, *, alt: str = "allele_count", total: str = "total_count"
) -> DataFrame:
    """Allelic fraction, depth and log2 depth of each (site, bin)."""
    return binned.withColumns(
        {
            "fraction": allelic_ratio(alt, total),
            "depth": F.col(total),
            "log_depth": F.log2(F.col(total) + 1),
        }
    )


def depth_summary(
    ase: DataFrame,
    *,
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
    depths: tuple[int, ...] = (3, 5, 10, 15),
) -> DataFrame:
    """Per cell: sites by minimum depth, and sites of depth 3 with both alleles."""
    t = F.col(total)
    return ase.groupBy(sample).agg(
        *[F.count_if(t >= d).alias(f"sites_{d}") for d in depths],
        F.count_if((t >= depths[0]) & (minor_count(alt, total) > 0)).alias("biallelic"),
    )


def biallelic_summary(
    ase: DataFrame,
    *,
    min_reads: int = 10,
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Per cell: expressed and biallelic sites, their ratio, and the global minor fraction.

    Sites count from ``min_reads`` on; the global fraction uses every observed site.
    """
    deep = F.col(total) >= min_reads
    minor = minor_count(alt, total)
    expressed = F.count_if(deep)
    both = F.count_if(deep & (minor > 0))
    return ase.groupBy(sample).agg(
        expressed.alias("n_expressed"),
        both.alias("n_biallelic"),
        F.when(expressed > 0, both / expressed).alias("fraction_biallelic"),
        F.when(F.sum(total) > 0, F.sum(minor) / F.sum(total)).alias("global_allelic_fraction"),
    )


def global_fraction(
    ase: DataFrame,
    *,
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Alternate reads over all reads of each cell, used as a covariate."""
    return ase.groupBy(sample).agg(
        F.when(F.sum(total) > 0, F.sum(alt) / F.sum(total)).alias("global_fraction")
    )


def batch_summary(
    counter: DataFrame,
    library: DataFrame | None = None,
    *,
    cell: str = "cell_id",
    ref: str = "ref_count",
    alt: str = "alt_count",
    max_reads: int = 5,
) -> DataFrame:
    """Per cell: sites with at least 1..n reads, biallelic sites, library size if known."""
    t = F.col(ref) + F.col(alt)
    out = counter.groupBy(cell).agg(
        *[F.count_if(t >= n).alias(f"sites_{n}") for n in range(1, max_reads + 1)],
        F.count_if((F.col(ref) > 0) & (F.col(alt) > 0)).alias("biallelic"),
    )
    return out if library is None else out.join(library, cell, "left")


# Bytes of counts by cell that a task makes at once.
_HELD = 64 << 20


def sample_match_score(
    ase: DataFrame,
    genotype: DataFrame,
    *,
    min_reads: int = 10,
    site: str = "site_id",
    sample: str = "sample_id",
    individual: str = "individual_id",
    dosage: str = "dosage",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Per (cell, candidate donor): share of deep sites whose allelic state fits the genotype.

    The donors' classes at a site are two bits each in one row, so that an entry meets one row and
    not one for every donor. Entries are dealt and sorted by cell; a task adds up the bits of one
    cell after another and passes on its counts by donor. A cell and a donor that share no called deep site have no row. Of
    several genotypes of a donor at a site, a heterozygous one counts.
    """
    called = genotype.where(F.col(dosage).isNotNull()).groupBy(site, individual).agg(
        F.max(F.bround(dosage) == 1).alias("_het")
    )
    called = cut_lineage(called.where(F.col(individual).isNotNull()))
    donors = cut_lineage(
        ranked(called.select(individual).distinct(), [individual], out="_d").withColumn("_d", F.col("_d") - 1)
    )
    n = donors.count()
    bit = F.when(F.col("_het"), 2).otherwise(0) + 1
    packed = called.join(broadcast_if_small(donors, width=2), individual).groupBy(site).agg(
        F.collect_list(F.struct(F.col("_d").cast("int").alias("d"), bit.alias("b"))).alias("_donors")
    )
    deep = ase.where(F.col(total) >= min_reads).select(
        site, sample, (minor_count(alt, total) > 0).alias("_both")
    )
    site_type, sample_type = (ase.schema[c].dataType.simpleString() for c in (site, sample))

    def pack(frames):
        for frame in frames:
            bits = []
            for row in frame["_donors"]:
                state = np.zeros(n, np.uint8)
                state[[r["d"] for r in row]] = [r["b"] for r in row]
                bits.append(np.packbits(np.concatenate([state & 1, state >> 1])).tobytes())
            yield pd.DataFrame({site: frame[site], "_bits": bits})

    sites = packed.mapInPandas(pack, f"`{site}` {site_type}, _bits binary")
    joined = deep.join(broadcast_if_small(cut_lineage(sites), width=4 + n // 32), site)

    def rows(cells, counts):
        at, donor = np.nonzero(counts[:, n:])
        for k in range(0, len(at), 1 << 16):
            i, d = at[k : k + (1 << 16)], donor[k : k + (1 << 16)]
            yield pd.DataFrame({sample: cells[i], "_d": d, "n_match": counts[i, d], "n_sites": counts[i, n + d]})

    def count(frames):
        last = None  # the cell that the next rows may go on with, and its counts
        step = max(1, _HELD // (16 * n))
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                code, cells = pd.factorize(frame[sample], use_na_sentinel=False)
                raw = np.frombuffer(b"".join(frame["_bits"]), np.uint8).reshape(len(frame), -1)
                bits = np.unpackbits(raw, axis=1)[:, : 2 * n].astype(bool)
                known = bits[:, :n]
                same = known & (bits[:, n:] == frame["_both"].to_numpy(dtype=bool)[:, None])
                first = np.searchsorted(code, np.arange(len(cells)))
                sums = np.add.reduceat(np.hstack([same, known]).astype(np.int64), first)
                cells = np.array(cells, object)
                if last is not None:
                    if cells[0] == last[0][0] or (pd.isna(cells[0]) and pd.isna(last[0][0])):
                        sums[0] += last[1][0]
                    else:
                        yield from rows(*last)
                yield from rows(cells[:-1], sums[:-1])
                last = cells[-1:], sums[-1:]
        if last is not None:
            yield from rows(*last)

    dealt = joined.select(sample, "_both", "_bits").repartition(sample).sortWithinPartitions(sample)
    summed = dealt.mapInPandas(
        count, f"`{sample}` {sample_type}, _d bigint, n_match bigint, n_sites bigint"
    )
    return summed.join(broadcast_if_small(donors, width=2), "_d").select(
        sample, individual, "n_match", "n_sites", (F.col("n_match") / F.col("n_sites")).alias("score")
    )


def allele_counts(
    observations: DataFrame,
    genotype: DataFrame,
    *,
    min_cov: int = 1,
    min_base_quality: int = 10,
    min_map_quality: int = 10,
    cell: str = "cell_id",
    site: str = "site_id",
) -> DataFrame:
    """Reference, alternate, other and low-quality base counts of each (cell, site).

    Observations carry ``base``, ``base_quality`` and ``map_quality``; the genotype table
    carries ``ref``, ``alt`` and ``dosage``. Only heterozygous sites are counted.
    """
    het = genotype.where(F.bround("dosage") == 1).select(site, "ref", "alt")
    low_map = F.col("map_quality") < min_map_quality
    low_base = ~low_map & (F.col("base_quality") < min_base_quality)
    good = ~low_map & ~low_base
    out = (
        observations.join(het, site)
        .groupBy(cell, site)
        .agg(
            F.count_if(good & (F.col("base") == F.col("ref"))).alias("ref_count"),
            F.count_if(good & (F.col("base") == F.col("alt"))).alias("alt_count"),
            F.count_if(
                good & (F.col("base") != F.col("ref")) & (F.col("base") != F.col("alt"))
            ).alias("other_bases"),
            F.count_if(low_map).alias("low_mapq_depth"),
            F.count_if(low_base).alias("low_baseq_depth"),
            F.count("*").alias("raw_depth"),
        )
    )
    return out.withColumn("total_count", F.col("ref_count") + F.col("alt_count")).where(
        F.col("total_count") >= min_cov
    )


def dedup_random(
    reads: DataFrame, key: list[str], *, seed: int = 0, read_id: str = "read_id"
) -> DataFrame:
    """One reproducible random record of each key."""
    pick = F.struct(hash_order(seed, read_id), F.col(read_id))
    row = F.struct(*reads.columns)
    return reads.groupBy(*key).agg(F.min_by(row, pick).alias("_r")).select("_r.*")


def rows_for_barcodes(
    reads: DataFrame, barcodes: DataFrame, *, barcode: str = "barcode"
) -> DataFrame:
    """Records of the listed barcodes; write them with ``write_partitioned``."""
    return reads.join(barcodes.select(barcode).distinct(), barcode, "left_semi")
