"""Readers of the text layouts of expression, genotype and allele-count studies.

Wide files exist only here: every reader returns a long table keyed by names, so nothing is
ever aligned by line number further on. Malformed numbers fail the read.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.plans.scale import broadcast_if_small, cut_lineage, ranked

_MISSING = ("NA", "NaN", "nan", "", "-")


def _name_from_path(path: Column, suffix: str = "") -> Column:
    """File name without its folder and the suffix."""
    return F.regexp_extract(path, rf"([^/]+?){suffix}$", 1)


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file, the start of their block and a number that grows in it."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _after(cells: str, n: int) -> Column:
    """The entries of an array after the first n, however many they are."""
    return F.slice(cells, F.lit(n + 1), F.greatest(F.size(cells) - n, F.lit(0)))


def read_wide_matrix(
    spark: SparkSession,
    path,
    *,
    id_column: str = "feature_id",
    sample_column: str = "sample_id",
    value_column: str = "value",
    sep: str = "\t",
    n_leading: int = 1,
    id_position: int = 0,
    header_start: int = 0,
    with_file: bool = False,
    as_double: bool = True,
) -> DataFrame:
    """Header of sample names and one row for each feature, to (feature, sample, value).

    Lines are split in place and met with their file's header, so the number of columns is
    no limit. ``n_leading`` columns come before the values; ``id_position`` is the one with
    the feature name. Missing marks become NULL.
    """
    lines = _lines(spark, path)
    heads = _headers(lines, sep)
    names = heads.select("_file", F.posexplode(_after("_head", n_leading)).alias("_pos", sample_column))
    is_head = (F.col("_block") == 0) & (F.col("_line") == F.col("_first"))
    body = lines.join(broadcast_if_small(heads.select("_file", "_first")), "_file").where(~is_head)
    long = body.withColumn("_cells", F.split("value", sep)).select(
        "_file",
        F.col("_cells")[id_position].alias(id_column),
        F.posexplode(_after("_cells", n_leading)).alias("_pos", "_v"),
    )
    value = F.when(F.col("_v").isin(*_MISSING), None).otherwise(F.col("_v"))
    out = long.join(broadcast_if_small(names), ["_file", "_pos"]).select(
        *(["_file"] if with_file else []),
        id_column,
        sample_column,
        (value.cast("double") if as_double else value).alias(value_column),
    )
    return out


def _headers(lines: DataFrame, sep: str) -> DataFrame:
    """First line of every file, split, and its number; only first blocks can hold one. It is
    written once, since names and body both need it."""
    first = lines.where("_block = 0").groupBy("_file").agg(
        F.min_by("value", "_line").alias("_raw"), F.min("_line").alias("_first")
    )
    return cut_lineage(first.select("_file", "_first", F.split("_raw", sep).alias("_head")))


def write_wide_matrix(
    df: DataFrame,
    path: str,
    samples: Sequence[str],
    *,
    id_column: str = "feature_id",
    sample_column: str = "sample_id",
    value_column: str = "value",
    sep: str = "\t",
    missing: str = "NA",
    header: bool = True,
) -> None:
    """One line of tab-separated values for each feature, samples in the given order.

    The values of a feature are one array of at most ``len(samples)`` entries; a sample
    without a row is written as missing. Every part file has the header line, which is what
    ``read_wide_matrix`` expects of a folder.
    """
    order = df.sparkSession.createDataFrame(
        list(enumerate(samples)), ["_pos", sample_column]
    )
    placed = df.join(broadcast_if_small(order), sample_column)
    rows = placed.groupBy(id_column).agg(
        F.map_from_entries(
            F.collect_list(F.struct("_pos", F.col(value_column).cast("string")))
        ).alias("_m")
    )
    cells = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(len(samples) - 1).cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(missing)),
    )
    line = F.concat_ws(sep, F.col(id_column).cast("string"), cells)
    # a one-column table named by the header line; the separator never occurs in it
    named = rows.select(line.alias(sep.join([id_column, *samples])))
    named.write.mode("overwrite").csv(path, sep="\u0001", quote="", header=header)


def read_gene_annotation(spark: SparkSession, path, *, autosomes_only: bool = True) -> DataFrame:
    """Annotation table: Ensembl id, chromosome, start, end, strand, symbol, type, status.

    The transcription start is the start on the plus strand and the end on the minus strand.
    Only known protein-coding genes are kept, and by default only autosomes.
    """
    schema = (
        "ensembl_id string, chrom_name string, start_pos bigint, end_pos bigint, strand string, "
        "gene_symbol string, gene_type string, gene_status string"
    )
    table = spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=True)
    kept = table.where((F.col("gene_type") == "protein_coding") & (F.col("gene_status") == "KNOWN"))
    if autosomes_only:
        kept = kept.where(~F.col("chrom_name").isin("chrX", "chrY", "chrM"))
    return kept.select(
        F.substring_index("ensembl_id", ".", 1).alias("gene_id"),
        "gene_symbol",
        F.regexp_replace("chrom_name", "^chr", "").cast("int").alias("chrom"),
        "start_pos",
        "end_pos",
        "strand",
        F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("end_pos")).alias("gene_tss"),
        "gene_type",
        "gene_status",
    )


def read_gtf_exons(spark: SparkSession, path, *, partitions: int | None = None) -> DataFrame:
    """Exons of known protein-coding genes from a GTF file. A gzip file is read by one task,
    so the rows are spread right after the read."""
    schema = (
        "seqname string, source string, feature string, start_pos bigint, end_pos bigint, "
        "score string, strand string, frame string, attributes string"
    )
    raw = spark.read.csv(path, schema=schema, sep="\t", comment="#", quote="")
    raw = raw.repartition(partitions) if partitions else raw.repartition("seqname", "start_pos")

    def attribute(name: str) -> Column:
        return F.regexp_extract("attributes", f'{name} "([^"]+)"', 1)

    exons = raw.where(F.col("feature") == "exon").select(
        F.substring_index(attribute("gene_id"), ".", 1).alias("gene_id"),
        F.regexp_replace("seqname", "^chr", "").alias("chrom"),
        "start_pos",
        "end_pos",
        attribute("gene_type").alias("gene_type"),
        attribute("gene_status").alias("gene_status"),
    )
    kept = exons.where((F.col("gene_type") == "protein_coding") & (F.col("gene_status") == "KNOWN"))
    return kept.withColumn("chrom", F.try_to_number("chrom", F.lit("99")).cast("int")).where(
        F.col("chrom").isNotNull()
    )


def read_genotype_by_chrom(
    spark: SparkSession, path, *, variants: DataFrame | None = None, sep: str = "\\s+"
) -> DataFrame:
    """Dosage matrices, one file per chromosome, to (variant, individual, dosage), with an
    optional list of variants."""
    long = read_wide_matrix(
        spark, path, id_column="variant_id", sample_column="individual_id",
        value_column="dosage", sep=sep,
    )
    if variants is not None:
        long = long.join(variants.select("variant_id").distinct(), "variant_id", "left_semi")
    dosage = F.when(F.col("dosage") >= 0, F.col("dosage"))
    parts = F.split("variant_id", "[:_]")
    return long.select(
        "variant_id",
        F.regexp_replace(parts[0], "^chr", "").try_cast("int").alias("chrom"),
        parts[1].try_cast("bigint").alias("pos"),
        "individual_id",
        dosage.alias("dosage"),
    )


def _with_ordinal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with their zero-based number: blocks by offset, and the lines
    of a block in the order in which its task reads them."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return ranked(lines, ["_block", "_line"], out="ordinal").select(
        (F.col("ordinal") - 1).alias("ordinal"), "value"
    )


def read_012_genotype(spark: SparkSession, geno: str, indv: str, pos: str) -> DataFrame:
    """Matrix of 0/1/2 with one line for each individual, beside files of individuals and
    positions; -1 is missing. The files have no keys, so lines are numbered once here."""
    rows = _with_ordinal(spark, geno).withColumn("_c", F.split("value", "\\s+")).select(
        "ordinal", F.posexplode(_after("_c", 1)).alias("_p", "_v")
    )
    people = _with_ordinal(spark, indv).select("ordinal", F.trim("value").alias("individual_id"))
    spots = _with_ordinal(spark, pos).select(
        F.col("ordinal").cast("int").alias("_p"), F.split("value", "\\s+").alias("_s")
    )
    spots = spots.select(
        "_p", F.regexp_replace(F.col("_s")[0], "^chr", "").cast("int").alias("chrom"),
        F.col("_s")[1].cast("bigint").alias("pos"),
    )
    joined = rows.join(people, "ordinal").join(spots, "_p")
    dosage = F.col("_v").cast("double")
    return joined.select(
        F.concat_ws(":", "chrom", "pos").alias("variant_id"), "chrom", "pos", "individual_id",
        F.when(dosage >= 0, dosage).alias("dosage"),
    )


def read_allelic_pairs(
    spark: SparkSession, alt_path, total_path, *, cells: DataFrame | None = None
) -> DataFrame:
    """Alternate and total count matrices of the same donors to one row per observed cell of
    the matrix."""
    names = dict(id_column="site_id", sample_column="sample_id")
    alt = read_wide_matrix(spark, alt_path, value_column="allele_count", **names)
    total = read_wide_matrix(spark, total_path, value_column="total_count", **names)
    both = alt.dropna().join(total.dropna(), ["site_id", "sample_id"]).select(
        "site_id", "sample_id", F.col("allele_count").cast("int"), F.col("total_count").cast("int")
    )
    if cells is not None:
        both = both.join(cells.select("sample_id").distinct(), "sample_id", "left_semi")
    return both


def read_ase_long(
    spark: SparkSession,
    path,
    *,
    tissues: Sequence[str] | None = None,
) -> DataFrame:
    """Long allele-count tables with one file per individual. Rows without a gene, or with a
    mapability, mapping-bias or genotype flag, are dropped."""
    positions = {
        "site_id": 2, "sample_id": 5, "tissue": 7, "ref_count": 8, "total_count": 10,
        "gene_id": 20, "low_mapability": 21, "mapping_bias": 22, "genotype_warning": 23,
    }
    cells = _lines(spark, path).select(F.split("value", "\t").alias("_c"))
    table = cells.where(F.size("_c") >= 24).select(
        *[F.col("_c")[i].alias(name) for name, i in positions.items()]
    )
    kept = table.where(
        F.col("total_count").try_cast("int").isNotNull()
        & ~F.col("gene_id").isin("NA", "")
        & (F.col("low_mapability") == "0")
        & (F.col("mapping_bias") == "0")
        & (F.col("genotype_warning") == "0")
    )
    if tissues is not None:
        kept = kept.where(F.col("tissue").isin(list(tissues)))
    total, ref = F.col("total_count").cast("int"), F.col("ref_count").cast("int")
    return kept.select(
        "site_id", "sample_id", "tissue", "gene_id", ref.alias("allele_count"), total.alias("total_count")
    )


def read_het_probabilities(spark: SparkSession, path, *, min_probability: float = 0.9) -> DataFrame:
    """Heterozygous (site, individual) pairs from a VCF-like file of probabilities."""
    lines = _lines(spark, path).where(~F.col("value").startswith("##"))
    cells = lines.select("_file", F.split("value", "\t").alias("_c"))
    head = cells.where(F.col("_c")[0].startswith("#")).select(
        "_file", F.posexplode(_after("_c", 9)).alias("_pos", "individual_id")
    )
    body = cells.where(F.col("_c")[2].startswith("rs")).select(
        "_file",
        F.col("_c")[2].alias("site_id"),
        F.posexplode(_after("_c", 9)).alias("_pos", "_p"),
    )
    likely = body.where(F.col("_p").cast("double") > min_probability)
    return likely.join(broadcast_if_small(head), ["_file", "_pos"]).select("site_id", "individual_id")


def read_ref_alt_het(spark: SparkSession, ref_path, alt_path, het_path) -> DataFrame:
    """Three sample x site matrices: counts of both alleles and heterozygosity. Entries
    without reads or without heterozygosity are absent."""
    names = dict(id_column="sample_id", sample_column="site_id")
    ref = read_wide_matrix(spark, ref_path, value_column="ref", **names)
    alt = read_wide_matrix(spark, alt_path, value_column="alt", **names)
    het = read_wide_matrix(spark, het_path, value_column="het", **names).where(F.col("het") != 0)
    joined = ref.join(alt, ["sample_id", "site_id"]).join(het, ["sample_id", "site_id"], "left_semi")
    total = (F.col("ref") + F.col("alt")).cast("int")
    return joined.where(total > 0).select(
        "site_id", "sample_id", F.col("ref").cast("int").alias("allele_count"), total.alias("total_count")
    )


def read_effect_sizes(spark: SparkSession, path, tests: DataFrame) -> DataFrame:
    """Slopes of the listed (gene, variant) pairs from per-chromosome parquet files, NULL
    where a pair was not tested."""
    table = spark.read.parquet(path).select(
        F.col("phenotype_id").alias("gene_id"), "variant_id", "slope"
    )
    return tests.select("gene_id", "variant_id").join(table, ["gene_id", "variant_id"], "left")


def read_bed_expression(spark: SparkSession, path, *, suffix: str = "\\..*") -> DataFrame:
    """BED expression files, gene in the fourth column; the file name gives the tissue."""
    long = read_wide_matrix(
        spark, path, id_column="gene_id", sample_column="sample_id", n_leading=4, id_position=3,
        with_file=True,
    )
    return long.select(
        _name_from_path(F.col("_file"), suffix).alias("tissue"), "gene_id", "sample_id", "value"
    )


def read_gene_sets(spark: SparkSession, path) -> DataFrame:
    """Ragged lines of set name, description and genes."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("_c"))
    return cells.where(F.size("_c") > 2).select(
        F.col("_c")[0].alias("set_id"), _after("_c", 2).alias("genes")
    )


def read_counter_tables(spark: SparkSession, path, *, suffix: str = "\\..*") -> DataFrame:
    """Allele-counter tables with one file per cell; the file name gives the cell."""
    schema = (
        "contig string, position bigint, variant_id string, ref_allele string, alt_allele string, "
        "ref_count int, alt_count int, total_count int, low_mapq_depth int, low_baseq_depth int, "
        "raw_depth int, other_bases int"
    )
    table = spark.read.csv(path, schema=schema, sep="\t", header=True)
    return table.select(
        _name_from_path(F.col("_metadata.file_path"), suffix).alias("cell_id"), *table.columns
    )


def write_partitioned(df: DataFrame, by: str | Sequence[str], path: str) -> None:
    """One folder of parquet files for each cell type, day, tissue, bin or barcode."""
    keys = [by] if isinstance(by, str) else list(by)
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def merge_part_results(spark: SparkSession, folder: str, n_jobs: int, suffix: str = "") -> DataFrame:
    """Rows of numbered job outputs ``<job>_<n><suffix>`` (files or folders of files) with one
    header each; an absent part is an error. Results that Spark wrote itself need no merge."""
    paths = [f"{folder.rstrip('/')}/{job}_{n_jobs}{suffix}" for job in range(n_jobs)]
    table = spark.read.csv(paths, sep="\t", header=True)  # fails if a part is not there
    names = [path.rsplit("/", 1)[1] for path in paths]
    listed = {part for file in table.inputFiles() for part in unquote(file).split("/")[-2:]}
    lost = [path for path, name in zip(paths, names) if name not in listed]
    if lost:
        raise ValueError(f"parts without files: {lost}")
    return table


def concat_classes(
    counts: Sequence[DataFrame], metadata: Sequence[DataFrame], *, cell: str = "cell_id"
) -> tuple[DataFrame, DataFrame]:
    """Counts and cell tables of several cell classes in one table each, kept to the cells
    that both have."""
    all_counts, all_cells = counts[0], metadata[0]
    for c in counts[1:]:
        all_counts = all_counts.unionByName(c)
    for m in metadata[1:]:
        all_cells = all_cells.unionByName(m, allowMissingColumns=True)
    return (
        all_counts.join(all_cells.select(cell).distinct(), cell, "left_semi"),
        all_cells.join(all_counts.select(cell).distinct(), cell, "left_semi"),
    )


def read_neighbors(spark: SparkSession, path, *, weighted: bool = False, header: bool = True) -> DataFrame:
    """Neighbour lists (cell, comma-joined indices, ids and weights) to edges."""
    names = ["cell_id", "kernel_width"] if weighted else ["cell_id"]
    names += ["neighbor_indices", "neighbor_ids"] + (["neighbor_weights"] if weighted else [])
    schema = ", ".join(f"{n} string" for n in names)
    table = spark.read.csv(path, schema=schema, sep="\t", header=header)
    parts = [F.split("neighbor_ids", ",").alias("id")]
    if weighted:
        parts.append(F.split("neighbor_weights", ",").alias("w"))
    kept = ["cell_id", *(["kernel_width"] if weighted else [])]
    edges = table.select(*kept, F.posexplode(F.arrays_zip(*parts)).alias("_pos", "_e"))
    out = edges.select(
        "cell_id", F.col("_e.id").alias("neighbor_id"), (F.col("_pos") + 1).alias("rank"),
        *([F.col("_e.w").cast("double").alias("weight")] if weighted else []),
        *([F.col("kernel_width").cast("double").alias("width")] if weighted else []),
    )
    return out


def write_neighbors(edges: DataFrame, path: str, cells: DataFrame, *, weighted: bool = False) -> None:
    """Edges to one line per cell: ids in rank order with indices and weights.

    ``cells`` gives ``cell_id`` and its zero-based ``index``.
    """
    index = cells.select(F.col("cell_id").alias("neighbor_id"), F.col("index").alias("_i"))
    item = F.struct(
        "rank", "neighbor_id", "_i", (F.col("weight") if weighted else F.lit(0.0)).alias("weight")
    )
    # a cell has as many entries as neighbours
    rows = edges.join(index, "neighbor_id").groupBy("cell_id").agg(
        F.array_sort(F.collect_list(item)).alias("_l"),
        *([F.first("width").alias("kernel_width")] if weighted else []),
    )

    def joined(name: str) -> Column:
        return F.concat_ws(",", F.transform("_l", lambda e: e[name].cast("string")))

    columns = ["cell_id", *(["kernel_width"] if weighted else [])]
    rows.select(
        *columns,
        joined("_i").alias("neighbor_indices"),
        joined("neighbor_id").alias("neighbor_cell_ids"),
        *([joined("weight").alias("neighbor_weights")] if weighted else []),
    ).write.mode("overwrite").csv(path, sep="\t", header=True)


def with_position(df: DataFrame) -> DataFrame:
    """Add where each row of a table read from files stands: ``_file``, the first byte of its
    ``_block``, and ``_line``, which rises along the rows of a block.

    Call it on the table as read, before any shuffle. Sorting by the three columns gives the order
    of the rows in the files, files by their paths.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
