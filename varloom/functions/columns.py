"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor_count(alt: str = "allele_count", total: str = "total_count") -> Column:
    """Reads of the rarer allele."""
    return F.least(F.col(alt), F.col(total) - F.col(alt))


def is_monoallelic(
    alt: str = "allele_count",
    total: str = "total_count",
    *,
    min_reads: int = 3,
    max_minor: float = 0.01,
) -> Column:
    """Too few reads, or nearly all reads from one allele."""
    return (F.col(total) < min_reads) | (minor_count(alt, total) / F.col(total) < max_minor)


def allelic_ratio(alt: str = "allele_count", total: str = "total_count") -> Column:
    """Share of alternate reads, missing without reads."""
    return F.when(F.col(total) > 0, F.col(alt) / F.col(total))


def capped_depth(
    max_total: int, alt: str = "allele_count", total: str = "total_count"
) -> tuple[Column, Column]:
    """Alternate and total counts scaled down to ``max_total`` reads, rounding half to even."""
    deep = F.col(total) > max_total
    scaled = F.bround(max_total * F.col(alt) / F.col(total)).cast("int")
    return (
        F.when(deep, scaled).otherwise(F.col(alt)),
        F.when(deep, F.lit(max_total)).otherwise(F.col(total)),
    )


def strip_version(gene_id: str) -> Column:
    """Gene id without the version after the point."""
    return F.substring_index(gene_id, ".", 1)


def symbol_of(compound: str) -> Column:
    """Symbol part of an ``id_symbol`` key."""
    return F.element_at(F.split(compound, "_", 2), 2)


def sample_label(*parts: str) -> Column:
    """Colon-joined sample id with blanks replaced by underscores."""
    return F.concat_ws(":", *[F.regexp_replace(F.col(p).cast("string"), " ", "_") for p in parts])


def neg_log10(p: str) -> Column:
    """-log10 of a p-value, kept finite at zero and never negative."""
    return F.greatest(-F.log10(F.col(p) + 1e-15), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation over the rows that have both values. NaN where one of them
    has no spread, which ``corr`` divides by; NULL for less than two rows."""
    square = F.regr_sxx(y, x) * F.regr_syy(y, x)
    r = F.regr_sxy(y, x) / F.sqrt(F.when(square > 0, square))
    return F.when(F.regr_count(y, x) > 1, F.coalesce(r, F.lit(float("nan"))))
