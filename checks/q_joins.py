"""Joins, selections and set operations on the driver tables, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import standins as S
from checks.q_basic import r, rnd
from checks.registry import query
from checks.standins import with_ctes
from varloom.functions import columns as C
from varloom.functions import special
from varloom.operators import joins as J
from varloom.operators import selection as K


def variants(t):
    """Orders as variants: many positions on five chromosomes."""
    return t.orders.select(
        F.col("o_orderkey").alias("variant_id"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"),
        (F.col("o_orderkey") * 13).alias("pos"),
    )


def part_genes(t):
    return t.part.select(
        F.col("p_partkey").alias("gene_id"),
        (F.col("p_size") % 5 + 1).cast("int").alias("chrom"),
        (F.col("p_partkey") * 97).alias("gene_tss"),
    )


_VAR = """v AS (SELECT o_orderkey AS variant_id, CAST(o_custkey % 5 + 1 AS INTEGER) AS chrom,
    o_orderkey * 13 AS variant_pos FROM orders),
    g AS (SELECT p_partkey AS gene_id, CAST(p_size % 5 + 1 AS INTEGER) AS chrom,
    p_partkey * 97 AS gene_tss FROM part)"""


@query(
    "cis_pairs",
    f"""WITH {_VAR} SELECT gene_id, variant_id, g.chrom, gene_tss, variant_pos FROM g JOIN v
    ON g.chrom = v.chrom AND variant_pos BETWEEN gene_tss - 500 AND gene_tss + 500""",
)
def _(t):
    return J.cis_pairs(part_genes(t), variants(t), 500)


_EXONS = """e AS (SELECT p_brand AS gene_id, CAST(p_size % 5 + 1 AS INTEGER) AS chrom,
    p_partkey * 97 AS start_pos, p_partkey * 97 + p_size * 4 AS end_pos FROM part)"""


@query(
    "map_sites_to_genes",
    f"""WITH {_VAR}, {_EXONS}, h AS (SELECT variant_id, min(e.gene_id) AS lo, max(e.gene_id) AS hi
      FROM v JOIN e ON v.chrom = e.chrom AND variant_pos BETWEEN start_pos AND end_pos GROUP BY 1)
    SELECT variant_id AS site_id, chrom, variant_pos AS pos,
      CASE WHEN lo = hi THEN lo END AS gene_id FROM v LEFT JOIN h USING (variant_id)""",
)
def _(t):
    exons = t.part.select(
        F.col("p_brand").alias("gene_id"),
        (F.col("p_size") % 5 + 1).cast("int").alias("chrom"),
        (F.col("p_partkey") * 97).alias("start_pos"),
        (F.col("p_partkey") * 97 + F.col("p_size") * 4).alias("end_pos"),
    )
    sites = variants(t).withColumnRenamed("variant_id", "site_id")
    return J.map_sites_to_genes(sites, exons, bin_width=200)


@query(
    "unique_genes",
    """WITH a AS (SELECT p_partkey // 3 AS gene_id, CAST(p_size % 2 AS INTEGER) AS chrom,
      p_partkey % 3 AS gene_tss, p_partkey AS ordinal FROM part),
    f AS (SELECT gene_id, arg_min(chrom, ordinal) AS chrom, arg_min(gene_tss, ordinal) AS gene_tss,
      min(ordinal) AS ordinal FROM a GROUP BY 1)
    SELECT * FROM f WHERE gene_id NOT IN (SELECT a.gene_id FROM a JOIN f USING (gene_id)
      WHERE a.chrom <> f.chrom AND a.gene_tss <> f.gene_tss)""",
)
def _(t):
    a = t.part.select(
        F.floor(F.col("p_partkey") / 3).alias("gene_id"),
        (F.col("p_size") % 2).alias("chrom"),
        (F.col("p_partkey") % 3).alias("gene_tss"),
        F.col("p_partkey").alias("ordinal"),
    )
    return J.unique_genes(a)


@query(
    "attach_expression",
    f"""{with_ctes("counts", "genes", "genotype")},
    v AS (SELECT DISTINCT variant_id, chrom, pos FROM genotype),
    p AS (SELECT gene_id, variant_id, v.chrom, start_pos AS gene_tss, pos AS variant_pos
      FROM genes g JOIN v ON g.chrom = v.chrom AND abs(pos - start_pos) <= 3000),
    e AS (SELECT individual_id, gene_id, sum(count) AS value FROM counts
      JOIN (SELECT o_orderkey AS cell_id, c_nationkey AS individual_id FROM orders
        JOIN customer ON o_custkey = c_custkey) USING (cell_id) GROUP BY 1, 2)
    SELECT p.*, individual_id, value FROM p JOIN e USING (gene_id)""",
)
def _(t):
    from varloom.operators.aggregates import pseudobulk

    pb = pseudobulk(S.counts(t), S.cells(t), ["individual_id"])
    e = pb.withColumnRenamed("count", "value")
    return J.attach_expression(stand_pairs(t, 3000), e)


def stand_pairs(t, distance):
    """Brand-type genes with the suppliers near them."""
    g = S.genes(t).withColumnRenamed("start_pos", "gene_tss")
    v = S.genotype(t).select("variant_id", "chrom", "pos").distinct()
    return J.cis_pairs(g, v, distance)


@query(
    "expand_genotype_to_cells",
    f"""{with_ctes("cells", "genotype")} SELECT variant_id, cell_type, count(*) AS n_cells,
    count(dosage) AS n_called, sum(dosage) AS dosage FROM cells JOIN genotype USING (individual_id)
    GROUP BY 1, 2""",
)
def _(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("variant_id"))
    # the cells get their type before they are expanded, so that only sums are shuffled
    typed = S.cells(t).select("cell_id", "individual_id").join(S.cells(t).select("cell_id", "cell_type"), "cell_id")
    out = J.expand_genotype_to_cells(pairs, S.genotype(t), typed, also=["cell_type"])
    return out.groupBy("variant_id", "cell_type").agg(
        F.count("*").alias("n_cells"),
        F.count("dosage").alias("n_called"),
        F.sum("dosage").alias("dosage"),
    )


@query(
    "attach_genotype_bulk",
    f"""{with_ctes("genotype")}, s AS (SELECT DISTINCT concat(c_nationkey, ':', c_mktsegment)
      AS sample_id, c_nationkey AS individual_id FROM customer)
    SELECT variant_id, sample_id, coalesce(dosage, 0) AS dosage
    FROM s JOIN genotype USING (individual_id)""",
)
def _(t):
    s = t.customer.select(
        F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("sample_id")
    ).distinct()
    return J.attach_genotype_bulk(s, S.genotype(t))


@query(
    "annotate_samples",
    """SELECT o_orderkey AS cell_id, o_custkey AS donor_id, c_mktsegment, c_acctbal, quality
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
    LEFT JOIN labels ON o_orderkey = doc_id""",
)
def _(t):
    samples = t.orders.select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("donor_id")
    )
    rich = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("donor_id"), "c_mktsegment", "c_acctbal"
    )
    marks = t.labels.select(F.col("doc_id").alias("cell_id"), "quality")
    return J.annotate_samples(samples, (rich, ["donor_id"]), (marks, ["cell_id"]))


@query(
    "append_cell_covariates",
    f"""{with_ctes("cells")} SELECT cells.*, n_lines FROM cells JOIN (SELECT l_orderkey AS cell_id,
    count(*) AS n_lines FROM lineitem GROUP BY 1) USING (cell_id)""",
)
def _(t):
    extra = t.lineitem.groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.count("*").alias("n_lines")
    )
    return J.append_cell_covariates(S.cells(t), extra)


@query(
    "join_het_sites",
    """WITH a AS (SELECT l_partkey AS site_id, l_suppkey AS individual_id,
      CAST(sum(l_linenumber) AS BIGINT) AS allele_count,
      CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total_count FROM lineitem GROUP BY 1, 2),
    h AS (SELECT DISTINCT l_partkey AS site_id, l_suppkey AS individual_id FROM lineitem
      WHERE l_discount >= 0.05),
    n AS (SELECT site_id FROM h GROUP BY 1 HAVING count(*) > 2)
    SELECT a.* FROM a JOIN h USING (site_id, individual_id) JOIN n USING (site_id)
    WHERE total_count > 0""",
)
def _(t):
    site, donor = F.col("l_partkey").alias("site_id"), F.col("l_suppkey").alias("individual_id")
    a = t.lineitem.groupBy(site, donor).agg(
        F.sum("l_linenumber").alias("allele_count"),
        F.sum(F.col("l_quantity").cast("int")).alias("total_count"),
    )
    h = t.lineitem.where("l_discount >= 0.05D").select(site, donor).distinct()
    return J.join_het_sites(a, h)


@query(
    "genes_in_all",
    """SELECT l_partkey AS gene_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) =
    (SELECT count(DISTINCT l_tax) FROM lineitem)""",
)
def _(t):
    e = t.lineitem.select(F.col("l_partkey").alias("gene_id"), "l_tax")
    return J.genes_in_all(e, "l_tax")


@query(
    "compare_results",
    f"""{with_ctes("tests")}, a AS (SELECT * FROM tests WHERE cell_type = 'A'),
    b AS (SELECT * FROM tests WHERE cell_type = 'R')
    SELECT count(*) AS n_tests, {rnd("corr(a.beta, b.beta)")} AS r_beta,
    {rnd("corr(greatest(-log10(a.pvalue + 1e-15), 0), greatest(-log10(b.pvalue + 1e-15), 0))")}
    AS r_logp, {rnd("corr(CAST(a.ord AS DOUBLE), CAST(b.ord AS DOUBLE))")} AS r_ord
    FROM a JOIN b USING (gene_id, variant_id)""",
)
def _(t):
    x = S.tests(t).withColumn("ord", F.col("ord").cast("double"))
    a, b = x.where("cell_type = 'A'"), x.where("cell_type = 'R'")
    c = J.compare_results(a, b, also=["ord"])
    return c.withColumns({n: r(n) for n in ("r_beta", "r_logp", "r_ord")})


@query(
    "effect_size_matrix",
    f"""{with_ctes("tests")} SELECT gene_id, variant_id,
    {rnd("max(beta) FILTER (cell_type = 'A')")} AS "A",
    {rnd("max(beta) FILTER (cell_type = 'N')")} AS "N",
    {rnd("max(beta) FILTER (cell_type = 'R')")} AS "R" FROM tests GROUP BY 1, 2""",
)
def _(t):
    x = S.tests(t)
    m = J.effect_size_matrix(
        x, x, tissues=["A", "N", "R"], tissue="cell_type", slope="beta"
    )
    return m.withColumns({c: r(c) for c in "ANR"})


_ANC = f"""{with_ctes("tests")}, e AS (SELECT a.gene_id, a.variant_id, a.cell_type AS tissue,
      a.beta AS ea, CASE WHEN a.ord % 2 = 0 THEN a.pvalue END AS aa FROM tests a),
    f AS (SELECT gene_id, variant_id, avg(ord) / 1000 - 7 AS factor FROM tests GROUP BY 1, 2)"""


def ancestry(t):
    x = S.tests(t)
    e = x.select(
        "gene_id",
        "variant_id",
        F.col("cell_type").alias("tissue"),
        F.col("beta").alias("ea_slope"),
        F.when(F.col("ord") % 2 == 0, F.col("pvalue")).alias("aa_slope"),
    )
    f = x.groupBy("gene_id", "variant_id").agg((F.avg("ord") / 1000 - 7).alias("factor"))
    return e, f


@query(
    "ancestry_contrast",
    f"""{_ANC} SELECT gene_id, variant_id, {rnd("abs(any_value(factor))")} AS abs_factor,
    {rnd("median(abs(ea - aa))")} AS median_gap, count(ea) > 0 AS in_first,
    count(aa) > 0 AS in_second, count(ea) = 0 OR count(aa) = 0 AS missing
    FROM f JOIN e USING (gene_id, variant_id) GROUP BY 1, 2""",
)
def _(t):
    e, f = ancestry(t)
    x = J.ancestry_contrast(e, f)
    return x.withColumns({"abs_factor": r("abs_factor"), "median_gap": r("median_gap")})


@query(
    "tissue_contrast",
    f"""{_ANC} SELECT tissue, {rnd("corr(abs(ea - aa), abs(factor))")} AS r,
    count(abs(ea - aa)) AS n_tests FROM f JOIN e USING (gene_id, variant_id) GROUP BY 1""",
)
def _(t):
    return J.tissue_contrast(*ancestry(t)).withColumn("r", r("r"))


@query(
    "assemble_covariates",
    """WITH e AS (SELECT vec_id, embedding FROM embeddings) SELECT vec_id AS sample_id,
    label AS individual_id, {x} AS checksum FROM embeddings JOIN
    (SELECT label, arg_min(embedding, vec_id) AS g FROM embeddings GROUP BY 1) USING (label)
    """.format(
        x="round(list_sum(list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE))) + 2 * "
        "list_sum(list_transform(g[1:5], lambda v: CAST(v AS DOUBLE))), 5) + 0.0"
    ),
)
def _(t):
    e = t.embeddings.select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").alias("individual_id"),
        F.col("embedding").cast("array<double>").alias("pcs"),
    )
    donors = e.groupBy("individual_id").agg(F.min_by("pcs", "sample_id").alias("pcs"))
    out = J.assemble_covariates(e, donors, 10)

    def total(part):
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v)

    own, shared = F.slice("covariates", 1, 10), F.slice("covariates", 11, 5)
    return out.select(
        "sample_id", "individual_id", r(total(own) + 2 * total(shared), 5).alias("checksum")
    )


@query(
    "standardized_genotype",
    f"""{with_ctes("cells", "genotype")}, z AS (SELECT cell_type, variant_id,
      CASE WHEN stddev_pop(dosage) OVER w > 0 THEN (dosage - avg(dosage) OVER w)
        / stddev_pop(dosage) OVER w END AS z FROM cells JOIN genotype USING (individual_id)
      WHERE dosage IS NOT NULL WINDOW w AS (PARTITION BY variant_id))
    SELECT variant_id, cell_type, count(*) AS n_cells, {rnd("avg(z)", 5)} AS mean_z,
    {rnd("max(z)", 5)} AS max_z FROM z GROUP BY 1, 2""",
)
def _(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("variant_id"))
    z = J.cell_genotype(pairs, S.genotype(t), S.cells(t), standardize=True)
    return z.summary(["cell_type"]).select(
        "variant_id", "cell_type", "n_cells", r("mean", 5).alias("mean_z"), r("highest", 5).alias("max_z")
    )


@query(
    "standardized_genotype_rows",
    f"""{with_ctes("cells", "genotype")}, z AS (SELECT cell_id, variant_id, individual_id,
      CASE WHEN stddev_pop(dosage) OVER w > 0 THEN (dosage - avg(dosage) OVER w)
        / stddev_pop(dosage) OVER w END AS z FROM cells JOIN genotype USING (individual_id)
      WHERE dosage IS NOT NULL AND variant_id % 10 = 0 WINDOW w AS (PARTITION BY variant_id))
    SELECT cell_id, individual_id, variant_id, {rnd("z", 5)} AS dosage FROM z""",
)
def _(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("variant_id")).where("variant_id % 10 = 0")
    out = J.standardized_genotype(pairs, S.genotype(t), S.cells(t), digits=5)
    return out.select("cell_id", "individual_id", "variant_id", "dosage")


@query(
    "genotype_products",
    f"""{with_ctes("cells", "counts", "genotype", "tests")},
    p AS (SELECT DISTINCT gene_id, variant_id FROM tests WHERE pvalue < 0.001)
    SELECT gene_id, variant_id, {rnd("sum(count * dosage)", 4)} AS product FROM p
    JOIN counts USING (gene_id) JOIN cells USING (cell_id)
    JOIN genotype USING (variant_id, individual_id) GROUP BY 1, 2""",
)
def _(t):
    pairs = S.tests(t).where("pvalue < 0.001").select("gene_id", "variant_id")
    g = J.cell_genotype(pairs, S.genotype(t), S.cells(t))
    out = g.products(S.counts(t), pairs, value="count")
    return out.withColumn("product", r("product", 4))


@query(
    "index_labels",
    f"""{with_ctes("cells")} SELECT cell_id, donor_id,
    CAST(dense_rank() OVER (ORDER BY donor_id) - 1 AS INTEGER) AS label_index FROM cells""",
)
def _(t):
    return J.index_labels(S.cells(t).select("cell_id", "donor_id"), "donor_id")


@query(
    "index_labels_first_seen",
    f"""WITH l AS (SELECT l_shipdate AS label, min((l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1)
    SELECT label, CAST(row_number() OVER (ORDER BY first, label) - 1 AS INTEGER) AS label_index FROM l""",
)
def _(t):
    rows = t.lineitem.select(F.col("l_shipdate").alias("label"), "l_orderkey", "l_linenumber")
    out = J.index_labels(rows, "label", first_seen=["l_orderkey", "l_linenumber"])
    return out.select("label", "label_index").distinct()


# ------------------------------------------------------------- selection


@query("ld_prune")
def _(t):
    return K.ld_prune(stand_pairs(t, 60_000).select("gene_id", "variant_id"), S.genotype(t), 0.2)


def _greedy_sql(rounds: int) -> str:
    """The rounds of the greedy scan: a test that comes first for its gene and its variant is
    kept and removes those that share one of them. ``t0`` holds (gene, variant, k)."""
    parts = []
    for i in range(rounds):
        parts.append(f"""f{i} AS MATERIALIZED (SELECT gene_id, variant_id, k FROM (SELECT *,
            min(k) OVER (PARTITION BY gene_id) AS g, min(k) OVER (PARTITION BY variant_id) AS v FROM t{i})
          WHERE k = g AND k = v),
        t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE gene_id NOT IN (SELECT gene_id FROM f{i})
          AND variant_id NOT IN (SELECT variant_id FROM f{i}))""")
    return ", ".join(parts)


def _kept_sql(rounds: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(rounds))


_ROUNDS = 40


@query(
    "dedupe_tests",
    f"""{with_ctes("tests")}, t0 AS MATERIALIZED (SELECT gene_id, variant_id,
      row_number() OVER (ORDER BY pvalue, ord, cell_type, gene_id, variant_id) AS k, cell_type FROM tests),
    {_greedy_sql(_ROUNDS)}, kept AS ({_kept_sql(_ROUNDS)})
    SELECT gene_id, variant_id, cell_type, {rnd("pvalue", 9)} AS pvalue FROM kept
    JOIN (SELECT *, row_number() OVER (ORDER BY pvalue, ord, cell_type, gene_id, variant_id) AS k FROM tests)
      USING (gene_id, variant_id, k)""",
)
def _(t):
    out = K.dedupe_tests(S.tests(t), ["pvalue", "ord", "cell_type"])
    return out.select("gene_id", "variant_id", "cell_type", r("pvalue", 9).alias("pvalue"))


@query(
    "dedupe_tests_first",
    f"""{with_ctes("tests")}, o AS MATERIALIZED (SELECT *, row_number() OVER
      (ORDER BY pvalue, ord, cell_type, gene_id, variant_id) AS k FROM tests),
    t0 AS MATERIALIZED (SELECT gene_id, variant_id, k FROM o),
    {_greedy_sql(_ROUNDS)}, kept AS ({_kept_sql(_ROUNDS)})
    SELECT o.gene_id, o.variant_id, cell_type FROM kept JOIN o USING (k) ORDER BY k LIMIT 25""",
)
def _(t):
    out = K.dedupe_tests(S.tests(t), ["pvalue", "ord", "cell_type"], 25)
    return out.select("gene_id", "variant_id", "cell_type")


@query(
    "sample_tests",
    f"""{with_ctes("tests")}, d AS (SELECT *, md5(concat_ws('|', '3', cell_type, gene_id, variant_id)) AS h FROM tests),
    n AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY h, gene_id, variant_id) AS n FROM d),
    o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY list_position(['R', 'N', 'A'], cell_type), n,
      gene_id, variant_id) AS k FROM n WHERE n <= 30),
    t0 AS MATERIALIZED (SELECT gene_id, variant_id, k FROM o),
    {_greedy_sql(_ROUNDS)}, kept AS ({_kept_sql(_ROUNDS)})
    SELECT o.gene_id, o.variant_id, cell_type, ord FROM kept JOIN o USING (k)""",
)
def _(t):
    out = K.sample_tests(S.tests(t), 30, "cell_type", 3, by_order=["R", "N", "A"])
    return out.select("gene_id", "variant_id", "cell_type", "ord")


@query(
    "top_tests_by_factor",
    """WITH l AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS factor,
      CAST(unnest(embedding) AS DOUBLE) AS weight FROM embeddings)
    SELECT vec_id, factor, round(weight, 6) + 0.0 AS weight FROM
    (SELECT *, rank() OVER (PARTITION BY factor ORDER BY abs(weight) DESC) AS k FROM l)
    WHERE k <= 5""",
)
def _(t):
    w = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = K.top_tests_by_factor(w, 5, keys=["vec_id"])
    return top.withColumn("weight", r("weight"))


@query(
    "top_tests_by_factor_effects",
    f"""{with_ctes("tests")}, w AS (SELECT gene_id, variant_id, max(beta) AS a, sum(ord % 7) AS b
      FROM tests GROUP BY 1, 2),
    l AS (SELECT gene_id, variant_id, 0 AS factor, a AS weight FROM w
      UNION ALL SELECT gene_id, variant_id, 1, CAST(b AS DOUBLE) FROM w)
    SELECT gene_id, variant_id, factor, {rnd("weight")} AS weight, cell_type, {rnd("beta")} AS beta FROM
    (SELECT *, rank() OVER (PARTITION BY factor ORDER BY abs(weight) DESC) AS k FROM l)
    JOIN tests USING (gene_id, variant_id) WHERE k <= 1500""",
)
def _(t):
    x = S.tests(t)
    w = x.groupBy("gene_id", "variant_id").agg(
        F.array(F.max("beta"), F.sum(F.col("ord") % 7).cast("double")).alias("v")
    )
    effects = x.select("gene_id", "variant_id", "cell_type", "beta")
    top = K.top_tests_by_factor(w, 1500, effects=effects)
    return top.withColumns({c: r(c) for c in ("weight", "beta")})


@query(
    "union_all",
    """SELECT c_custkey AS id, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return K.union_all(a, b)


@query(
    "distinct_tests",
    f"{with_ctes('tests')} SELECT DISTINCT gene_id, variant_id FROM tests",
)
def _(t):
    return K.distinct_tests(S.tests(t))


@query(
    "intersect_tests",
    f"""{with_ctes("tests")} SELECT gene_id, variant_id FROM tests WHERE cell_type = 'A'
    INTERSECT SELECT gene_id, variant_id FROM tests WHERE cell_type = 'N'""",
)
def _(t):
    x = S.tests(t)
    return K.intersect_tests(x.where("cell_type = 'A'"), x.where("cell_type = 'N'"))


@query(
    "same_tests",
    f"""{with_ctes("tests")}, a AS (SELECT gene_id, variant_id FROM tests WHERE cell_type = 'A'),
    n AS (SELECT gene_id, variant_id FROM tests WHERE cell_type = 'N')
    SELECT NOT EXISTS ((SELECT * FROM a EXCEPT SELECT * FROM n) UNION ALL
      (SELECT * FROM n EXCEPT SELECT * FROM a)) AS same, count(*) AS n_tests FROM a""",
)
def _(t):
    x = S.tests(t)
    a, n = x.where("cell_type = 'A'"), x.where("cell_type = 'N'")
    return a.agg(F.lit(K.same_tests(a, n)).alias("same"), F.count("*").alias("n_tests"))


@query(
    "distinct_levels",
    f"""{with_ctes("genes")} SELECT gene_id, dense_rank() OVER (ORDER BY gene_id) - 1 AS place
    FROM genes""",
)
def _(t):
    return K.distinct_levels(S.genes(t), "gene_id")


@query(
    "one_hot",
    f"""{with_ctes("cells")} SELECT cell_id, CAST(cell_type = 'F' AS DOUBLE) AS "cell_type_F",
    CAST(cell_type = 'O' AS DOUBLE) AS "cell_type_O", 1.0::DOUBLE AS intercept FROM cells""",
)
def _(t):
    x = K.one_hot(S.cells(t).select("cell_id", "cell_type"), "cell_type", ["F", "O", "P"])
    return K.add_intercept(x.drop("cell_type"))


@query(
    "string_keys",
    """SELECT p_partkey, split_part(p_brand, '#', 2) AS brand_no,
    concat(replace(p_name, ' ', '_'), ':', replace(p_type, ' ', '_')) AS sample_id,
    starts_with(p_name, 'red') AS is_red FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.split("p_brand", "#")[1].alias("brand_no"),
        C.sample_label("p_name", "p_type").alias("sample_id"),
        F.col("p_name").startswith("red").alias("is_red"),
    )


@query(
    "math_functions",
    """SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log2(p_retailprice), 6) AS log2,
    round(exp(-p_size / 10.0), 6) AS exp, round(sqrt(p_size), 6) AS sqrt,
    round(1 / (1 + exp(-(p_size - 25) / 5.0)), 6) AS sigmoid,
    CAST(sign(p_size - 25) AS DOUBLE) AS sign FROM part""",
)
def _(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        r(F.ln("p_retailprice")).alias("ln"),
        r(F.log2("p_retailprice")).alias("log2"),
        r(F.exp(-size / 10.0)).alias("exp"),
        r(F.sqrt(size)).alias("sqrt"),
        r(1 / (1 + F.exp(-(size - 25) / 5.0))).alias("sigmoid"),
        F.signum(size - 25).alias("sign"),
    )


@query(
    "special_functions",
    """WITH x AS (SELECT p_partkey, p_size / 3.0 AS a, p_retailprice / 100 AS b FROM part)
    SELECT p_partkey, round(lgamma(a), 6) + 0.0 AS gammaln,
    round((8 * (lgamma(b + 0.01) - lgamma(b - 0.01)) - (lgamma(b + 0.02) - lgamma(b - 0.02))) / 0.12, 5) + 0.0 AS digamma,
    round(lgamma(a) + lgamma(b) - lgamma(a + b), 5) + 0.0 AS betaln,
    round(1 / (1 + exp(-a)), 6) + 0.0 AS sigmoid,
    round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) + 0.0 AS logsumexp FROM x""",
)
def _(t):
    def values(frames):
        for frame in frames:
            a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
            out = frame[["p_partkey"]].copy()
            out["gammaln"], out["digamma"] = special.gammaln(a), special.digamma(b)
            out["betaln"], out["sigmoid"] = special.betaln(a, b), special.sigmoid(a)
            out["logsumexp"] = special.logsumexp(np.stack([a, b]), axis=0)
            yield out

    x = t.part.select("p_partkey", (F.col("p_size") / 3.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    names = {"gammaln": 6, "digamma": 5, "betaln": 5, "sigmoid": 6, "logsumexp": 6}
    out = x.mapInPandas(values, "p_partkey bigint, " + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: r(c, d) for c, d in names.items()})
