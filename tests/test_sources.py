"""Readers and writers on small text files."""

import gzip

import pandas as pd
import pytest

from varloom.sources import text as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def put(path, content):
    path.write_text(content)
    return str(path)


def test_wide_matrix_round_trip(spark, tmp_path):
    a = put(tmp_path / "a.txt", "gene\ts1\ts2\ng1\t1.5\tNA\ng2\t0\t-2\n")
    df = S.read_wide_matrix(spark, a)
    got = {(r["feature_id"], r["sample_id"]): r["value"] for r in df.collect()}
    assert got == {("g1", "s1"): 1.5, ("g1", "s2"): None, ("g2", "s1"): 0.0, ("g2", "s2"): -2.0}
    out = str(tmp_path / "wide")
    S.write_wide_matrix(df.dropna(), out, ["s2", "s1"], header=False)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["g1\tNA\t1.5", "g2\t-2.0\t0.0"]
    again = str(tmp_path / "again")
    S.write_wide_matrix(df.dropna(), again, ["s2", "s1"])
    back = S.read_wide_matrix(spark, again)
    assert {(r["feature_id"], r["sample_id"]): r["value"] for r in back.collect()} == got


def test_files_keep_their_own_header(spark, tmp_path):
    put(tmp_path / "chr1.txt", "id i1 i2\n1:10 0 2\n1:20 -1 1\n")
    put(tmp_path / "chr2.txt", "id i2 i3\n2:5 1 1\n")
    g = S.read_genotype_by_chrom(spark, str(tmp_path / "chr*.txt"))
    got = {(r["variant_id"], r["individual_id"]): r["dosage"] for r in g.collect()}
    assert got == {
        ("1:10", "i1"): 0.0, ("1:10", "i2"): 2.0, ("1:20", "i1"): None, ("1:20", "i2"): 1.0,
        ("2:5", "i2"): 1.0, ("2:5", "i3"): 1.0,
    }
    listed = spark.createDataFrame([("2:5",)], ["variant_id"])
    assert S.read_genotype_by_chrom(spark, str(tmp_path / "chr*.txt"), variants=listed).count() == 2


def test_annotation_and_gtf(spark, tmp_path):
    head = "id\tchr\tstart\tend\tstrand\tsymbol\ttype\tstatus\n"
    p = put(
        tmp_path / "anno.txt",
        head + "E1.4\tchr1\t10\t20\t+\tA\tprotein_coding\tKNOWN\n"
        "E2.1\tchr2\t30\t40\t-\tB\tprotein_coding\tKNOWN\n"
        "E3.1\tchrX\t1\t2\t+\tC\tprotein_coding\tKNOWN\n"
        "E4.1\tchr3\t1\t2\t+\tD\tlincRNA\tKNOWN\n",
    )
    assert rows(S.read_gene_annotation(spark, p), "gene_id", "chrom", "gene_tss") == [("E1", 1, 10), ("E2", 2, 40)]
    gtf = tmp_path / "g.gtf.gz"
    line = 'chr1\tx\t{}\t5\t9\t.\t+\t.\tgene_id "E1.2"; gene_type "{}"; gene_status "KNOWN";\n'
    with gzip.open(gtf, "wt") as f:
        f.write("##comment\n" + line.format("exon", "protein_coding") + line.format("gene", "protein_coding") + line.format("exon", "lincRNA"))
    assert rows(S.read_gtf_exons(spark, str(gtf)), "gene_id", "chrom", "start_pos", "end_pos") == [("E1", 1, 5, 9)]


def test_012_triple(spark, tmp_path):
    geno = put(tmp_path / "x.012", "0\t0\t2\n1\t-1\t1\n")
    indv = put(tmp_path / "x.indv", "anna\nbo\n")
    pos = put(tmp_path / "x.pos", "1\t100\n1\t200\n")
    got = {(r["variant_id"], r["individual_id"]): r["dosage"] for r in S.read_012_genotype(spark, geno, indv, pos).collect()}
    assert got == {("1:100", "anna"): 0.0, ("1:200", "anna"): 2.0, ("1:100", "bo"): None, ("1:200", "bo"): 1.0}


def test_allelic_readers(spark, tmp_path):
    alt = put(tmp_path / "d.altcount.tsv", "site\tc1\tc2\ns1\t1\t\ns2\t0\t3\n")
    tot = put(tmp_path / "d.totalcount.tsv", "site\tc1\tc2\ns1\t4\t\ns2\t2\t5\n")
    got = S.read_allelic_pairs(spark, alt, tot)
    assert rows(got, "site_id", "sample_id", "allele_count", "total_count") == [
        ("s1", "c1", 1, 4), ("s2", "c1", 0, 2), ("s2", "c2", 3, 5)
    ]
    only = spark.createDataFrame([("c2",)], ["sample_id"])
    assert S.read_allelic_pairs(spark, alt, tot, cells=only).count() == 1
    cells = ["x"] * 24
    def long(site, tissue, gene, flag="0"):
        c = list(cells)
        c[2], c[5], c[7], c[8], c[10], c[20], c[21], c[22], c[23] = site, "i", tissue, "3", "7", gene, "0", "0", flag
        return "\t".join(c)
    p = put(tmp_path / "long.txt", "\n".join(["\t".join(["h"] * 24), long("a", "lung", "g"), long("b", "skin", "g"), long("c", "lung", "NA"), long("d", "lung", "g", "1")]))
    assert rows(S.read_ase_long(spark, p, tissues=["lung"]), "site_id", "allele_count", "total_count") == [("a", 3, 7)]


def test_het_and_ref_alt(spark, tmp_path):
    fixed = "\t".join(["1", "5", "{}", "A", "C", ".", ".", ".", "."])
    p = put(tmp_path / "h.vcf", "##x\n#" + fixed.format("ID") + "\tann\tbob\n" + fixed.format("rs1") + "\t0.95\t0.5\n" + fixed.format(".") + "\t1\t1\n")
    assert rows(S.read_het_probabilities(spark, p), "site_id", "individual_id") == [("rs1", "ann")]
    ref = put(tmp_path / "ref", "id\ts1\ts2\np1\t3\t0\np2\t1\t1\n")
    alt = put(tmp_path / "alt", "id\ts1\ts2\np1\t2\t0\np2\t1\t0\n")
    het = put(tmp_path / "het", "id\ts1\ts2\np1\t1\t1\np2\t0\t1\n")
    assert rows(S.read_ref_alt_het(spark, ref, alt, het), "site_id", "sample_id", "allele_count", "total_count") == [
        ("s1", "p1", 3, 5), ("s2", "p2", 1, 1)
    ]


def test_other_readers(spark, tmp_path):
    gmt = put(tmp_path / "s.gmt", "set1\turl\tA\tB\nset2\turl\tC\n")
    assert rows(S.read_gene_sets(spark, gmt), "set_id", "genes") == [("set1", ["A", "B"]), ("set2", ["C"])]
    put(tmp_path / "lung.bed", "#c\ts\te\tgene\tx1\n1\t2\t3\tg1\t5.0\n")
    got = S.read_bed_expression(spark, str(tmp_path / "*.bed"))
    assert rows(got, "tissue", "gene_id", "sample_id", "value") == [("lung", "g1", "x1", 5.0)]
    head = "\t".join("c p v r a rc ac tc m b d o".split())
    put(tmp_path / "cell7.counts", head + "\n1\t5\trs\tA\tC\t2\t3\t5\t0\t0\t5\t0\n")
    got = S.read_counter_tables(spark, str(tmp_path / "*.counts"))
    assert rows(got, "cell_id", "ref_count", "alt_count") == [("cell7", 2, 3)]
    eff = str(tmp_path / "eff")
    spark.createDataFrame([("g1", "v1", 0.5)], ["phenotype_id", "variant_id", "slope"]).write.parquet(eff)
    tests = spark.createDataFrame([("g1", "v1"), ("g1", "v2")], ["gene_id", "variant_id"])
    assert rows(S.read_effect_sizes(spark, eff, tests), "variant_id", "slope") == [("v1", 0.5), ("v2", None)]


def test_results_neighbours_and_partitions(spark, tmp_path):
    put(tmp_path / "0_2.txt", "gene\tp\na\t0.1\n")
    put(tmp_path / "1_2.txt", "gene\tp\nb\t0.2\n")
    assert S.merge_part_results(spark, str(tmp_path), 2, ".txt").count() == 2
    with pytest.raises(Exception):
        S.merge_part_results(spark, str(tmp_path), 3, ".txt").count()
    edges = spark.createDataFrame(
        [("a", "b", 1, 0.5, 0.7), ("a", "c", 2, 0.25, 0.7)], "cell_id string, neighbor_id string, rank int, weight double, width double"
    )
    cells = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], ["cell_id", "index"])
    out = str(tmp_path / "knn")
    S.write_neighbors(edges, out, cells, weighted=True)
    assert rows(S.read_neighbors(spark, out, weighted=True), "cell_id", "neighbor_id", "rank", "weight") == [
        ("a", "b", 1, 0.5), ("a", "c", 2, 0.25)
    ]
    parts = str(tmp_path / "parts")
    S.write_partitioned(edges, "neighbor_id", parts)
    assert spark.read.parquet(parts).where("neighbor_id = 'c'").count() == 1
    c1 = spark.createDataFrame([("x", "g", 1.0), ("y", "g", 2.0)], ["cell_id", "gene_id", "count"])
    m1 = spark.createDataFrame([("x", "B")], ["cell_id", "cell_type"])
    m2 = spark.createDataFrame([("z", "T")], ["cell_id", "cell_type"])
    counts, meta = S.concat_classes([c1], [m1, m2])
    assert counts.count() == 1 and meta.count() == 1
    assert isinstance(meta.toPandas(), pd.DataFrame)


def test_wide_readers_have_no_column_limit(spark, tmp_path):
    n = 1_000_003
    (tmp_path / "m.txt").write_text(
        "id\t" + "\t".join(f"s{i}" for i in range(n)) + "\nf\t" + "\t".join(["1"] * n) + "\n"
    )
    out = S.read_wide_matrix(spark, str(tmp_path / "m.txt"))
    assert out.count() == n and out.agg({"value": "sum"}).first()[0] == n
    head = "\t".join(["#CHROM", *"bcdefghi", *[f"p{i}" for i in range(n)]])
    line = "\t".join(["1", "5", "rs1", *"defghi", *["0.95"] * n])
    (tmp_path / "h.vcf").write_text(f"##x\n{head}\n{line}\n")
    assert S.read_het_probabilities(spark, str(tmp_path / "h.vcf")).count() == n


def test_a_body_line_equal_to_the_header_stays(spark, tmp_path):
    (tmp_path / "m.txt").write_text("id\ta\nid\ta\nf\t2\n")
    out = S.read_wide_matrix(spark, str(tmp_path / "m.txt"), as_double=False)
    assert sorted((r.feature_id, r.value) for r in out.collect()) == [("f", "2"), ("id", "a")]
