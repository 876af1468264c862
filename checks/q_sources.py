"""Text layouts written from the driver tables and read back, with the tables' own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import standins as S
from checks.q_basic import PB_MATRIX, pb_matrix
from checks.q_models import _EDGES, edges
from checks.registry import query
from checks.standins import with_ctes
from varloom.plans.scale import checkpoint_folder
from varloom.sources import text as R


def fresh(t) -> str:
    return f"{checkpoint_folder(t.spark).rstrip('/')}/text-{uuid.uuid4().hex}"


def written_wide(t, df, samples, **names) -> str:
    """A folder of wide files of the table."""
    path = fresh(t)
    R.write_wide_matrix(df, path, samples, **names)
    return path


@query("wide_matrix_round_trip", f"WITH {PB_MATRIX} SELECT CAST(gene_id AS VARCHAR) AS gene_id, sample_id, value FROM m")
def _(t):
    names = dict(id_column="gene_id", sample_column="sample_id")
    samples = [f"{flag}{line}" for flag in "ANR" for line in range(1, 8)]
    path = written_wide(t, pb_matrix(t), samples, **names)
    # a pair without a row is written as missing and read as NULL
    return R.read_wide_matrix(t.spark, path, **names).where("value IS NOT NULL")


@query(
    "merge_part_results",
    f"""{with_ctes("tests")} SELECT gene_id, CAST(variant_id AS VARCHAR) AS variant_id, cell_type,
    CAST(ord AS VARCHAR) AS ord FROM tests""",
)
def _(t):
    path, rows = fresh(t), S.tests(t).select("gene_id", "variant_id", "cell_type", "ord")
    for job in range(4):
        part = rows.where(F.col("variant_id") % 4 == job)
        part.write.csv(f"{path}/{job}_4.txt", sep="\t", header=True)
    return R.merge_part_results(t.spark, path, 4, ".txt")


@query(
    "allelic_pairs_round_trip",
    """SELECT CAST(l_partkey AS VARCHAR) AS site_id, l_returnflag AS sample_id,
    CAST(sum(least(CAST(l_quantity AS INTEGER), l_linenumber)) AS INTEGER) AS allele_count,
    CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS total_count FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    q = F.col("l_quantity").cast("int")
    a = t.lineitem.groupBy(
        F.col("l_partkey").alias("site_id"), F.col("l_returnflag").alias("sample_id")
    ).agg(F.sum(F.least(q, F.col("l_linenumber"))).alias("alt"), F.sum(q).alias("total"))
    names = dict(id_column="site_id", sample_column="sample_id")
    alt = written_wide(t, a, ["A", "N", "R"], value_column="alt", **names)
    total = written_wide(t, a, ["A", "N", "R"], value_column="total", **names)
    return R.read_allelic_pairs(t.spark, alt, total)


@query(
    "gene_sets_round_trip",
    """SELECT DISTINCT p_name AS set_id, concat(p_brand, '_', p_type) AS gene_id FROM part""",
)
def _(t):
    sets = t.part.groupBy("p_name").agg(F.collect_set(S.gene_key()).alias("genes"))
    path = fresh(t)
    sets.select(F.concat_ws("\t", "p_name", F.lit("url"), F.concat_ws("\t", "genes"))).write.text(path)
    return R.read_gene_sets(t.spark, path).select("set_id", F.explode("genes").alias("gene_id"))


@query(
    "neighbors_round_trip",
    f"""{with_ctes("cells")}, {_EDGES} SELECT CAST(cell_id AS VARCHAR) AS cell_id,
    CAST(neighbor_id AS VARCHAR) AS neighbor_id, CAST(row_number() OVER
    (PARTITION BY e.cell_id ORDER BY e.neighbor_id) AS INTEGER) AS rank FROM edges e""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("neighbor_id")
    e = edges(t).withColumn("rank", F.row_number().over(w))
    index = S.cells(t).select("cell_id", F.col("cell_id").alias("index"))
    path = fresh(t)
    R.write_neighbors(e, path, index)
    return R.read_neighbors(t.spark, path)


@query(
    "partitioned_round_trip",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    path = fresh(t)
    R.write_partitioned(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus", path)
    return t.spark.read.parquet(path).where("o_orderstatus = 'F'")


@query(
    "effect_sizes",
    f"""{with_ctes("tests")}, a AS (SELECT DISTINCT gene_id, variant_id FROM tests),
    b AS (SELECT gene_id, variant_id, beta FROM tests WHERE cell_type = 'A')
    SELECT gene_id, variant_id, round(beta, 6) + 0.0 AS slope FROM a LEFT JOIN b
    USING (gene_id, variant_id)""",
)
def _(t):
    x, path = S.tests(t), fresh(t)
    x.where("cell_type = 'A'").select(
        F.col("gene_id").alias("phenotype_id"), "variant_id", F.col("beta").alias("slope")
    ).write.parquet(path)
    out = R.read_effect_sizes(t.spark, path, x.select("gene_id", "variant_id").distinct())
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "concat_classes",
    f"""{with_ctes("counts", "cells")} SELECT counts.* FROM counts WHERE cell_id IN
    (SELECT cell_id FROM cells WHERE cell_type IN ('F', 'O'))""",
)
def _(t):
    cells, counts = S.cells(t), S.counts(t)
    return R.concat_classes(
        [counts], [cells.where("cell_type = 'F'"), cells.where("cell_type = 'O'")]
    )[0]


def lines_with_header(df, line, header: str, path: str) -> str:
    """Write one line for each row; every part file begins with the header."""
    out = df.select(line.alias(header)).write.option("comment", "~")  # else "#" gets quoted
    out.csv(path, sep="\u0001", quote="", header=True)
    return path


@query(
    "gene_annotation_round_trip",
    f"""{with_ctes("genes")} SELECT gene_id, gene_symbol, chrom, start_pos, end_pos, strand,
    CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS gene_tss, gene_type, gene_status
    FROM genes WHERE gene_type = 'protein_coding' AND gene_status = 'KNOWN'""",
)
def _(t):
    path = fresh(t)
    S.genes(t).select(
        F.concat("gene_id", F.lit(".7")).alias("id"),
        F.concat(F.lit("chr"), "chrom").alias("chrom"),
        "start_pos",
        "end_pos",
        "strand",
        "gene_symbol",
        "gene_type",
        "gene_status",
    ).write.csv(path, sep="\t", header=True)
    return R.read_gene_annotation(t.spark, path)


@query(
    "gtf_exons_round_trip",
    """SELECT p_brand AS gene_id, p_partkey AS start_pos, p_partkey + p_size AS end_pos,
    'protein_coding' AS gene_type, 'KNOWN' AS gene_status, CAST(p_size % 22 + 1 AS INTEGER) AS chrom
    FROM part WHERE p_size % 3 <> 0 AND p_partkey % 4 <> 0""",
)
def _(t):
    path = fresh(t)
    kind = F.when(F.col("p_size") % 3 == 0, "lincRNA").otherwise("protein_coding")
    note = F.format_string('gene_id "%s.2"; gene_type "%s"; gene_status "KNOWN";', "p_brand", kind)
    feature = F.when(F.col("p_partkey") % 4 == 0, "gene").otherwise("exon")
    chrom = F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("string"))
    fields = [chrom, F.lit("x"), feature, "p_partkey", F.col("p_partkey") + F.col("p_size")]
    line = F.concat_ws("\t", *fields, F.lit("."), F.lit("+"), F.lit("."), note)
    t.part.select(line).write.text(path)
    return R.read_gtf_exons(t.spark, path)


_DOSAGE = f"""{with_ctes("genotype")}, v AS (SELECT DISTINCT variant_id, chrom, pos FROM genotype),
    i AS (SELECT n_nationkey AS individual_id FROM nation)
    SELECT concat(v.chrom, ':', v.pos) AS variant_id, v.chrom, v.pos,
    CAST(i.individual_id AS VARCHAR) AS individual_id, g.dosage FROM v CROSS JOIN i
    LEFT JOIN genotype g ON g.variant_id = v.variant_id AND g.individual_id = i.individual_id"""


def named_genotype(t):
    return S.genotype(t).withColumn("variant_id", F.concat_ws(":", "chrom", "pos"))


@query("genotype_by_chrom_round_trip", _DOSAGE)
def _(t):
    people = [str(r.n_nationkey) for r in t.nation.orderBy("n_nationkey").collect()]  # 25 nations
    names = dict(id_column="variant_id", sample_column="individual_id", value_column="dosage")
    path = written_wide(t, named_genotype(t), people, **names)
    return R.read_genotype_by_chrom(t.spark, path)


@query("genotype_012_round_trip", _DOSAGE)
def _(t):
    g, base = named_genotype(t), fresh(t)
    spots = g.select("variant_id", "chrom", "pos").distinct()
    grid = spots.join(t.nation.select(F.col("n_nationkey").alias("individual_id")))
    full = grid.join(g.select("variant_id", "individual_id", "dosage"), ["variant_id", "individual_id"], "left")
    mark = F.coalesce(F.col("dosage").cast("int"), F.lit(-1)).cast("string")
    rows = full.groupBy("individual_id").agg(
        F.sort_array(F.collect_list(F.struct("chrom", "pos", mark.alias("m")))).alias("l")
    )  # one line of the file for each individual
    line = F.concat_ws("\t", F.col("individual_id").cast("string"), F.col("l.m"))
    one = dict(geno=rows.orderBy("individual_id").select(line), indv=rows.orderBy("individual_id").select(F.col("individual_id").cast("string")))
    one["pos"] = spots.orderBy("chrom", "pos").select(F.concat_ws("\t", "chrom", "pos"))
    for name, df in one.items():  # the three files are aligned by line, so each is one file
        df.coalesce(1).write.text(f"{base}-{name}")
    return R.read_012_genotype(t.spark, f"{base}-geno", f"{base}-indv", f"{base}-pos")


@query(
    "ase_long_round_trip",
    """SELECT CAST(l_partkey AS VARCHAR) AS site_id, CAST(l_orderkey AS VARCHAR) AS sample_id,
    l_returnflag AS tissue, CAST(l_suppkey AS VARCHAR) AS gene_id, l_linenumber AS allele_count,
    l_linenumber + CAST(l_quantity AS INTEGER) AS total_count FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_linenumber <> 3 AND l_suppkey % 5 <> 0""",
)
def _(t):
    cells = [F.lit("x")] * 24
    total = F.col("l_linenumber") + F.col("l_quantity").cast("int")
    gene = F.when(F.col("l_suppkey") % 5 == 0, "NA").otherwise(F.col("l_suppkey").cast("string"))
    flag = F.when(F.col("l_linenumber") == 3, "1").otherwise("0")
    at = {2: "l_partkey", 5: "l_orderkey", 7: "l_returnflag", 8: "l_linenumber", 10: total}
    for i, c in (at | {20: gene, 21: flag, 22: F.lit("0"), 23: F.lit("0")}).items():
        cells[i] = c
    header = "\t".join(f"h{i}" for i in range(24))
    path = lines_with_header(t.lineitem, F.concat_ws("\t", *cells), header, fresh(t))
    return R.read_ase_long(t.spark, path, tissues=["A", "R"])


@query(
    "het_probabilities_round_trip",
    """SELECT concat('rs', p_partkey) AS site_id, concat('i', i) AS individual_id
    FROM part, generate_series(0, 9) AS s(i) WHERE p_partkey % 7 <> 0
    AND CAST((p_partkey * 31 + i * 17) % 100 AS DOUBLE) / 100 > 0.9""",
)
def _(t):
    name = F.when(F.col("p_partkey") % 7 == 0, ".").otherwise(F.concat(F.lit("rs"), F.col("p_partkey")))
    chance = [((F.col("p_partkey") * 31 + i * 17) % 100).cast("double") / 100 for i in range(10)]
    fixed = [F.lit("1"), F.lit("5"), name, *[F.lit("x")] * 6]
    line = F.concat_ws("\t", *fixed, *[c.cast("string") for c in chance])
    header = "\t".join(["#CHROM", *"abcdefgh", *[f"i{i}" for i in range(10)]])
    return R.read_het_probabilities(t.spark, lines_with_header(t.part, line, header, fresh(t)))


@query(
    "ref_alt_het_round_trip",
    """WITH a AS (SELECT l_partkey AS p, l_returnflag AS s, sum(l_linenumber) AS ref,
    sum(CAST(l_quantity AS INTEGER)) % 4 AS alt, count(*) % 2 AS het FROM lineitem GROUP BY 1, 2)
    SELECT s AS site_id, CAST(p AS VARCHAR) AS sample_id, CAST(ref AS INTEGER) AS allele_count,
    CAST(ref + alt AS INTEGER) AS total_count FROM a WHERE het <> 0""",
)
def _(t):
    q = F.sum(F.col("l_quantity").cast("int"))
    a = t.lineitem.groupBy(F.col("l_partkey").alias("sample_id"), F.col("l_returnflag").alias("site_id"))
    a = a.agg(F.sum("l_linenumber").alias("ref"), (q % 4).alias("alt"), (F.count("*") % 2).alias("het"))
    names = dict(id_column="sample_id", sample_column="site_id")
    paths = [written_wide(t, a, ["A", "N", "R"], value_column=c, missing="0", **names) for c in ("ref", "alt", "het")]
    return R.read_ref_alt_het(t.spark, *paths)


@query(
    "bed_expression_round_trip",
    """SELECT CAST(p_partkey AS VARCHAR) AS gene_id, concat('x', i) AS sample_id,
    CAST((p_partkey * 13 + i) % 50 AS DOUBLE) AS value FROM part, generate_series(0, 4) AS s(i)""",
)
def _(t):
    values = [((F.col("p_partkey") * 13 + i) % 50).cast("string") for i in range(5)]
    line = F.concat_ws("\t", F.lit("1"), F.lit("2"), F.lit("3"), "p_partkey", *values)
    header = "\t".join(["#c", "s", "e", "gene", *[f"x{i}" for i in range(5)]])
    return R.read_bed_expression(t.spark, lines_with_header(t.part, line, header, fresh(t))).drop("tissue")


@query(
    "counter_tables_round_trip",
    """SELECT l_returnflag AS contig, l_orderkey AS position, CAST(l_partkey AS VARCHAR) AS variant_id,
    l_linenumber AS ref_count, l_linenumber + 1 AS alt_count, 2 * l_linenumber + 1 AS total_count
    FROM lineitem""",
)
def _(t):
    path, n = fresh(t), F.col("l_linenumber")
    letters = [F.lit("A").alias("r"), F.lit("C").alias("a")]
    counts = [n.alias("rc"), (n + 1).alias("ac"), (2 * n + 1).alias("tc")]
    rest = [F.lit(0).alias(c) for c in ("m", "b", "d", "o")]
    t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", *letters, *counts, *rest).write.csv(path, sep="\t", header=True)
    return R.read_counter_tables(t.spark, path).select(
        "contig", "position", "variant_id", "ref_count", "alt_count", "total_count"
    )


@query(
    "neighbors_weighted_round_trip",
    f"""{with_ctes("cells")}, {_EDGES} SELECT CAST(cell_id AS VARCHAR) AS cell_id,
    CAST(neighbor_id AS VARCHAR) AS neighbor_id, CAST(row_number() OVER
    (PARTITION BY e.cell_id ORDER BY e.neighbor_id) AS INTEGER) AS rank,
    CAST(neighbor_id % 8 AS DOUBLE) / 8 AS weight, CAST(cell_id % 4 AS DOUBLE) / 4 AS width FROM edges e""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("neighbor_id")
    e = edges(t).withColumn("rank", F.row_number().over(w))
    e = e.withColumn("weight", (F.col("neighbor_id") % 8).cast("double") / 8)
    e = e.withColumn("width", (F.col("cell_id") % 4).cast("double") / 4)
    path = fresh(t)
    R.write_neighbors(e, path, S.cells(t).select("cell_id", F.col("cell_id").alias("index")), weighted=True)
    return R.read_neighbors(t.spark, path, weighted=True)
