"""Filters, aggregates and normalisation on the driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from checks.standins import with_ctes
from varloom.operators import aggregates as A
from varloom.operators import filters as Fi
from varloom.operators import normalize as N


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding without negative zeros."""
    return f"(round({expr}, {digits}) + 0.0)"


def r(col, digits: int = 6):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# ---------------------------------------------------------------- filters


@query(
    "filter_cells",
    f"""{with_ctes("counts")} SELECT * FROM counts WHERE cell_id IN
    (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) FILTER (count > 0) >= 4)""",
)
def _(t):
    return Fi.filter_cells(S.counts(t), 4)


@query(
    "filter_genes",
    f"""{with_ctes("counts")} SELECT * FROM counts WHERE gene_id IN
    (SELECT gene_id FROM counts GROUP BY 1 HAVING count(*) FILTER (count > 0) >=
       0.028 * (SELECT count(DISTINCT cell_id) FROM counts))""",
)
def _(t):
    return Fi.filter_genes(S.counts(t), min_fraction=0.028)


@query(
    "qc_metrics",
    f"""{with_ctes("counts")} SELECT cell_id, count(*) FILTER (count > 0) AS n_genes,
    sum(count) AS n_counts,
    {rnd("sum(CASE WHEN starts_with(gene_id, 'Brand#1') THEN count ELSE 0 END) / sum(count)")}
      AS percent_mito FROM counts GROUP BY 1""",
)
def _(t):
    q = Fi.qc_metrics(S.counts(t), mito_prefix="Brand#1")
    return q.withColumn("percent_mito", r("percent_mito"))


@query(
    "qc_cells",
    f"""{with_ctes("counts")} SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM counts
    GROUP BY 1 HAVING count(*) FILTER (count > 0) < 6 AND
    sum(CASE WHEN starts_with(gene_id, 'Brand#1') THEN count ELSE 0 END) / sum(count) < 0.4)""",
)
def _(t):
    return Fi.qc_cells(S.counts(t), max_genes=6, max_mito=0.4, mito_prefix="Brand#1")


@query(
    "filter_gene_type",
    f"""{with_ctes("genes")} SELECT * FROM genes WHERE gene_type = 'protein_coding'
    AND gene_status = 'KNOWN' AND chrom BETWEEN 1 AND 22""",
)
def _(t):
    return Fi.filter_gene_type(S.genes(t))


@query(
    "filter_to_gene_set",
    f"""{with_ctes("counts", "genes")} SELECT * FROM counts WHERE gene_id IN
    (SELECT gene_id FROM genes WHERE gene_type = 'protein_coding' AND gene_status = 'KNOWN')""",
)
def _(t):
    return Fi.filter_to_gene_set(S.counts(t), Fi.filter_gene_type(S.genes(t)))


@query("filter_category", f"{with_ctes('cells')} SELECT * FROM cells WHERE cell_type = 'F'")
def _(t):
    return Fi.filter_category(S.cells(t), "cell_type", "F")


@query(
    "filter_genotyped_cells",
    f"""{with_ctes("cells", "genotype")} SELECT * FROM cells WHERE individual_id IN
    (SELECT individual_id FROM genotype GROUP BY 1 HAVING avg(dosage) > 1)""",
)
def _(t):
    g = Fi.keep_groups(S.genotype(t), ["individual_id"], F.avg("dosage") > 1)
    return Fi.filter_genotyped_cells(S.cells(t), g)


_MAF = "least(sum(dosage) / (2 * count(dosage)), 1 - sum(dosage) / (2 * count(dosage)))"


@query(
    "filter_maf",
    f"""{with_ctes("genotype")} SELECT * FROM genotype WHERE variant_id IN
    (SELECT variant_id FROM genotype GROUP BY 1 HAVING {_MAF} >= 0.45)""",
)
def _(t):
    return Fi.filter_maf(S.genotype(t), 0.45)


@query(
    "filter_complete_variants",
    f"""{with_ctes("genotype")} SELECT * FROM genotype WHERE variant_id NOT IN
    (SELECT variant_id FROM genotype WHERE dosage IS NULL)""",
)
def _(t):
    return Fi.filter_complete_variants(S.genotype(t))


@query(
    "remove_zero_genes",
    f"""{with_ctes("counts")} SELECT * FROM counts WHERE gene_id IN
    (SELECT gene_id FROM counts GROUP BY 1 HAVING sum(count) <> 0)""",
)
def _(t):
    return Fi.remove_zero_genes(S.counts(t), value="count")


@query(
    "select_covariates",
    "SELECT vec_id, CAST(unnest(embedding[1:10]) AS DOUBLE) AS c FROM embeddings",
)
def _(t):
    cut = Fi.select_covariates(t.embeddings, 10, column="embedding")
    return cut.select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("c"))


@query(
    "sample_cells",
    f"""{with_ctes("cells")} SELECT * FROM cells WHERE cell_id IN (SELECT cell_id FROM
    (SELECT cell_id, row_number() OVER (ORDER BY md5(concat_ws('|', '7', cell_id)), cell_id) AS k,
     count(*) OVER () AS n FROM cells) WHERE k <= floor(n * 0.2))""",
)
def _(t):
    return Fi.sample_cells(S.cells(t), 0.2, 7)


@query(
    "filter_significant",
    f"""{with_ctes("tests", "genes")}, ok AS (SELECT * FROM tests WHERE pvalue < 0.3
      AND NOT starts_with(gene_id, 'Brand#2') AND gene_id IN (SELECT gene_id FROM genes
      WHERE gene_status = 'KNOWN'))
    SELECT gene_id, variant_id, cell_type, {rnd("pvalue", 9)} AS pvalue, ord FROM
    (SELECT *, row_number() OVER (PARTITION BY gene_id, variant_id ORDER BY
       CASE cell_type WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS k FROM ok) WHERE k = 1""",
)
def _(t):
    known = S.genes(t).where(F.col("gene_status") == "KNOWN")
    kept = Fi.filter_significant(
        S.tests(t), 0.3, expressed=known, skip_prefix="Brand#2", group_order=["R", "N", "A"]
    )
    return kept.select("gene_id", "variant_id", "cell_type", r("pvalue", 9).alias("pvalue"), "ord")


@query(
    "filter_gene_set_cells",
    f"""{with_ctes("counts", "cells")} SELECT * FROM counts WHERE cell_id IN
    (SELECT cell_id FROM cells WHERE batch = '1-URGENT')""",
)
def _(t):
    urgent = S.cells(t).where(F.col("batch") == "1-URGENT")
    return Fi.filter_gene_set_cells(S.counts(t), urgent)


# ------------------------------------------------------------- aggregates


@query(
    "pseudobulk",
    f"""{with_ctes("counts", "cells")} SELECT donor_id, cell_type, gene_id, sum(count) AS count
    FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3""",
)
def _(t):
    return A.pseudobulk(S.counts(t), S.cells(t), ["donor_id", "cell_type"])


@query(
    "pseudobulk_per_individual",
    f"""{with_ctes("counts", "cells")} SELECT individual_id, gene_id, sum(count) AS count
    FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2""",
)
def _(t):
    return A.pseudobulk(S.counts(t), S.cells(t), ["individual_id"])


@query(
    "pseudobulk_samples",
    f"""{with_ctes("cells")} SELECT donor_id, batch, min(population) AS population,
    count(*) AS n_cells, min(population) = max(population) AS population_ok,
    concat(donor_id, ':', replace(batch, ' ', '_')) AS sample_id FROM cells GROUP BY 1, 2""",
)
def _(t):
    return A.pseudobulk_samples(S.cells(t), ["donor_id", "batch"])


@query(
    "feature_stats",
    f"""{with_ctes("counts", "genes")}, n AS (SELECT count(DISTINCT cell_id) AS n FROM counts)
    SELECT gene_id, {rnd("sum(count) / any_value(n)")} AS mean,
    {rnd("sum(count * count) / any_value(n) - (sum(count) / any_value(n)) * (sum(count) / any_value(n))", 5)}
      AS variance, {rnd("(any_value(n) - count(*)) / any_value(n)")} AS fraction_zero,
    sum(count) AS total, {rnd("count(*) / any_value(n)")} AS fraction_expressed
    FROM counts, n GROUP BY 1""",
)
def _(t):
    c = S.counts(t)
    s = A.feature_stats(c, c.select(F.count_distinct("cell_id")).scalar())
    return s.select(
        "gene_id",
        r("mean").alias("mean"),
        r("variance", 5).alias("variance"),
        r("fraction_zero").alias("fraction_zero"),
        "total",
        r("fraction_expressed").alias("fraction_expressed"),
    )


@query(
    "maf",
    f"""{with_ctes("genotype")} SELECT variant_id,
    {rnd("sum(dosage) / (2 * count(dosage))")} AS af, {rnd(_MAF)} AS maf
    FROM genotype GROUP BY 1""",
)
def _(t):
    return A.maf(S.genotype(t)).select("variant_id", r("af").alias("af"), r("maf").alias("maf"))


@query(
    "impute_mean",
    f"""{with_ctes("genotype")} SELECT variant_id, individual_id,
    {rnd("coalesce(dosage, avg(dosage) OVER (PARTITION BY variant_id))")} AS dosage
    FROM genotype""",
)
def _(t):
    g = A.impute_mean(S.genotype(t))
    return g.select("variant_id", "individual_id", r("dosage").alias("dosage"))


@query(
    "library_size",
    f"{with_ctes('counts')} SELECT cell_id, sum(count) AS library_size FROM counts GROUP BY 1",
)
def _(t):
    return A.library_size(S.counts(t))


LEADS = """leads AS (SELECT gene_id, arg_min(variant_id, (pvalue, -ord)) AS variant_id,
    arg_min(cell_type, (pvalue, -ord)) AS cell_type, min(pvalue) AS pvalue,
    arg_min(ord, (pvalue, -ord)) AS ord, count(*) AS num_snps_in_gene FROM tests GROUP BY 1)"""


def leads(t):
    return A.lead_variant(S.tests(t), order="ord")


@query(
    "lead_variant",
    f"""{with_ctes("tests")}, {LEADS} SELECT gene_id, variant_id, {rnd("pvalue", 12)} AS pvalue,
    num_snps_in_gene FROM leads""",
)
def _(t):
    x = leads(t)
    return x.select("gene_id", "variant_id", r("pvalue", 12).alias("pvalue"), "num_snps_in_gene")


@query(
    "composition",
    f"""{with_ctes("cells")} SELECT individual_id, cell_type, count(*) AS n_cells,
    {rnd("count(*) / sum(count(*)) OVER (PARTITION BY individual_id)")} AS proportion
    FROM cells GROUP BY 1, 2""",
)
def _(t):
    c = A.composition(S.cells(t), "individual_id", "cell_type")
    return c.withColumn("proportion", r("proportion"))


@query(
    "composition_with_zeros",
    f"""{with_ctes("cells")}, d AS (SELECT DISTINCT donor_id FROM cells)
    SELECT d.donor_id, l.cell_type, count(c.cell_id) AS n_cells
    FROM d CROSS JOIN (VALUES ('F'), ('O'), ('P')) AS l(cell_type)
    LEFT JOIN cells c ON c.donor_id = d.donor_id AND c.cell_type = l.cell_type GROUP BY 1, 2""",
)
def _(t):
    return A.composition_with_zeros(S.cells(t), "donor_id", "cell_type", ["F", "O", "P"])


@query(
    "modal_category",
    f"""{with_ctes("cells")} SELECT donor_id, batch FROM (SELECT donor_id, batch,
    row_number() OVER (PARTITION BY donor_id ORDER BY count(*) DESC, batch) AS k
    FROM cells GROUP BY 1, 2) WHERE k = 1""",
)
def _(t):
    return A.modal_category(S.cells(t), "donor_id", "batch")


@query(
    "distinct_per_group",
    f"""{with_ctes("cells")} SELECT plate_id, count(*) AS n_cells,
    count(DISTINCT batch) AS n_batch, count(DISTINCT day) AS n_day FROM cells GROUP BY 1""",
)
def _(t):
    return A.distinct_per_group(S.cells(t), "plate_id", "batch", "day")


@query(
    "egenes_by_group",
    f"""{with_ctes("tests")}, sig AS (SELECT cell_type, count(DISTINCT gene_id) AS n_egenes
      FROM tests WHERE pvalue < 0.0001 GROUP BY 1),
    s AS (SELECT l_returnflag AS cell_type, count(*) AS n_cells FROM lineitem GROUP BY 1)
    SELECT cell_type, n_cells, coalesce(n_egenes, 0) AS n_egenes
    FROM s LEFT JOIN sig USING (cell_type)""",
)
def _(t):
    samples = t.lineitem.select(F.col("l_returnflag").alias("cell_type"))
    return A.egenes_by_group(S.tests(t).where("pvalue < 0.0001"), samples)


@query(
    "egene_cell_correlation",
    f"""{with_ctes("tests")}, sig AS (SELECT cell_type, count(DISTINCT gene_id) AS n_egenes
      FROM tests WHERE pvalue < 0.0001 GROUP BY 1),
    s AS (SELECT l_returnflag AS cell_type, count(*) AS n_cells FROM lineitem GROUP BY 1)
    SELECT {rnd("corr(n_cells, coalesce(n_egenes, 0))")} AS r, count(*) AS n_groups
    FROM s LEFT JOIN sig USING (cell_type)""",
)
def _(t):
    samples = t.lineitem.select(F.col("l_returnflag").alias("cell_type"))
    table = A.egenes_by_group(S.tests(t).where("pvalue < 0.0001"), samples)
    return A.egene_cell_correlation(table).withColumn("r", r("r"))


# loadings of the embeddings: the vector is the loading array of a sample
@query(
    "factor_composition",
    """SELECT CAST(factor AS INTEGER) AS factor, label, count(*) AS n_samples FROM
    (SELECT label, unnest(range(64)) AS factor, unnest(embedding) AS x FROM embeddings)
    WHERE x > 0.1 GROUP BY 1, 2""",
)
def _(t):
    e = t.embeddings
    return A.factor_composition(e, e, "label", cut=0.1, sample="vec_id", column="embedding")


@query(
    "loading_correlation",
    """WITH l AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS f,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT a.f AS factor_a, b.f AS factor_b, round(abs(corr(a.x, b.x)), 5) AS abs_r
    FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2""",
)
def _(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    c = A.loading_correlation(e, e, sample="vec_id", column="embedding")
    return c.withColumn("abs_r", r("abs_r", 5))


@query(
    "covariate_r2",
    """WITH l AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS factor,
        CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings),
    num AS (SELECT factor, 'vec_id' AS covariate, regr_r2(y, vec_id) AS r2, count(*) AS n, 2 AS p
      FROM l GROUP BY 1),
    lev AS (SELECT factor, label, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w
      FROM l GROUP BY 1, 2),
    cat AS (SELECT factor, 'label' AS covariate,
      (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n))
      / (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) + sum(w)) AS r2,
      CAST(sum(n) AS BIGINT) AS n, count(*) AS p FROM lev GROUP BY 1)
    SELECT factor, covariate, round(1 - (1 - r2) * (n - 1) / (n - p), 5) + 0.0 AS adj_r2
    FROM (SELECT * FROM num UNION ALL SELECT * FROM cat)""",
)
def _(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    x = A.covariate_r2(
        e.select("vec_id", "embedding"),
        e.select("vec_id", F.col("vec_id").alias("position"), "label"),
        numeric=["position"],
        categorical=["label"],
        sample="vec_id",
        column="embedding",
    )
    named = F.when(F.col("covariate") == "position", "vec_id").otherwise(F.col("covariate"))
    return x.withColumns({"covariate": named, "adj_r2": r("adj_r2", 5)})


@query(
    "covariate_pair_r2",
    """WITH l AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS factor,
        CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings),
    g AS (SELECT factor, label, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS yy,
      var_pop(vec_id) * count(*) AS xx, covar_pop(vec_id, y) * count(*) AS xy FROM l GROUP BY 1, 2),
    s AS (SELECT factor, sum(n) AS n, count(*) + 1 AS p,
      sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum(yy) AS w,
      sum(xy) * sum(xy) / sum(xx) AS e FROM g GROUP BY 1)
    SELECT factor, round(1 - (1 - (b + e) / (b + w)) * (n - 1) / (n - p), 5) + 0.0 AS adj_r2 FROM s""",
)
def _(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    x = A.covariate_pair_r2(
        e.select("vec_id", "embedding"),
        e.select("vec_id", "label", F.col("vec_id").alias("position")),
        "label",
        "position",
        numeric=True,
        sample="vec_id",
        column="embedding",
    )
    return x.withColumn("adj_r2", r("adj_r2", 5))


@query("covariate_pair_r2_categories")
def _(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    marks = t.labels.select(F.col("doc_id").alias("vec_id"), "quality")
    return A.covariate_pair_r2(
        e.select("vec_id", "embedding"),
        e.select("vec_id", "label").join(marks, "vec_id"),
        "label",
        "quality",
        sample="vec_id",
        column="embedding",
    )


# ----------------------------------------------------------- normalisation

_Z = "CASE WHEN stddev_pop({v}) OVER w > 0 THEN ({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w END"


@query(
    "standardize",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id, {rnd(_Z.format(v="count"), 5)} AS value
    FROM counts WINDOW w AS (PARTITION BY gene_id)""",
)
def _(t):
    c = S.counts(t).withColumnRenamed("count", "value")
    return N.standardize(c).select("cell_id", "gene_id", r("value", 5).alias("value"))


@query(
    "standardize_clip",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id,
    {rnd("greatest(least((count - avg(count) OVER w) / stddev_samp(count) OVER w, 1.5), -1.5)", 5)}
    AS value FROM counts WINDOW w AS (PARTITION BY gene_id)""",
)
def _(t):
    c = S.counts(t).withColumnRenamed("count", "value")
    z = N.standardize(c, ddof=1, clip=1.5)
    return z.select("cell_id", "gene_id", r("value", 5).alias("value"))


@query(
    "standardize_within",
    f"""{with_ctes("counts", "cells")} SELECT cell_id, gene_id, day,
    {rnd(_Z.format(v="count"), 5)} AS value FROM counts JOIN cells USING (cell_id)
    WINDOW w AS (PARTITION BY gene_id, day)""",
)
def _(t):
    c = S.counts(t).join(S.cells(t).select("cell_id", "day"), "cell_id")
    z = N.standardize(c.withColumnRenamed("count", "value"), by=["gene_id", "day"])
    return z.select("cell_id", "gene_id", "day", r("value", 5).alias("value"))


@query(
    "center",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id,
    {rnd("ln(1 + count) - avg(ln(1 + count)) OVER (PARTITION BY gene_id)", 5)} AS value
    FROM counts""",
)
def _(t):
    c = N.center(S.counts(t).withColumn("value", F.log1p("count")))
    return c.select("cell_id", "gene_id", r("value", 5).alias("value"))


@query(
    "zero_center",
    """WITH x AS (SELECT event_type AS gene_id, event_id AS cell_id, value FROM events),
    raw AS (SELECT event_type AS gene_id, event_id AS cell_id FROM events WHERE props LIKE '%7%'),
    m AS (SELECT gene_id, avg(value) AS m FROM x ANTI JOIN raw USING (gene_id, cell_id) GROUP BY 1)
    SELECT gene_id, cell_id, round(value - m, 5) + 0.0 AS value FROM x LEFT JOIN m USING (gene_id)""",
)
def _(t):
    e = t.events.select(
        F.col("event_type").alias("gene_id"), F.col("event_id").alias("cell_id"), "value", "props"
    )
    raw = e.select("gene_id", "cell_id", F.col("props").contains("7").cast("int").alias("value"))
    z = N.zero_center(e.drop("props"), raw)
    return z.select("gene_id", "cell_id", r("value", 5).alias("value"))


@query(
    "equal_bins",
    f"""{with_ctes("cells")}, k AS (SELECT cell_id, pseudotime, count(*) OVER () AS n,
      row_number() OVER (ORDER BY pseudotime, cell_id) - 1 AS r FROM cells)
    SELECT cell_id, CAST(greatest((r * 7 + n - 1) // n - 1, 0) AS INTEGER) AS bin FROM k""",
)
def _(t):
    b = N.equal_bins(S.cells(t).select("cell_id", "pseudotime"), "pseudotime", 7, tie="cell_id")
    return b.select("cell_id", "bin")


@query(
    "top_variable_genes",
    f"""{with_ctes("counts")}, n AS (SELECT count(DISTINCT cell_id) AS n FROM counts),
    v AS (SELECT gene_id, sum(count * count) / any_value(n)
      - (sum(count) / any_value(n)) * (sum(count) / any_value(n)) AS v FROM counts, n GROUP BY 1),
    top AS (SELECT gene_id FROM (SELECT gene_id, rank() OVER (ORDER BY v DESC) AS k FROM v)
      WHERE k <= 20)
    SELECT cell_id, gene_id, count FROM counts WHERE gene_id IN (SELECT gene_id FROM top)""",
)
def _(t):
    c = S.counts(t)
    n = c.select("cell_id").distinct().count()
    top = N.top_variable_genes(c, 20, n_cells=n, value="count")
    return top.select("cell_id", "gene_id", "count")


@query(
    "top_variable_genes_standardized",
    f"""{with_ctes("counts")}, n AS (SELECT count(DISTINCT cell_id) AS n FROM counts),
    v AS (SELECT gene_id, sum(count) / any_value(n) AS m, sum(count * count) / any_value(n)
      - (sum(count) / any_value(n)) * (sum(count) / any_value(n)) AS v FROM counts, n GROUP BY 1),
    top AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY v DESC) AS k FROM v) WHERE k <= 20)
    SELECT cell_id, gene_id, {rnd("(count - m) / sqrt(v)", 4)} AS value, {rnd("-m / sqrt(v)", 4)} AS zero_value
    FROM counts JOIN top USING (gene_id)""",
)
def _(t):
    c = S.counts(t).withColumnRenamed("count", "value")
    n = c.select("cell_id").distinct().count()
    top = N.top_variable_genes(c, 20, n_cells=n, standardized=True)
    return top.select(
        "cell_id", "gene_id", r("value", 4).alias("value"), r("zero_value", 4).alias("zero_value")
    )


_FDR = f"""{with_ctes("tests")}, {LEADS}, b AS (SELECT *,
      least(1.0, pvalue * num_snps_in_gene) AS bf FROM leads),
    k AS (SELECT *, row_number() OVER (ORDER BY bf, gene_id) AS k, count(*) OVER () AS n FROM b),
    f AS (SELECT *, n * bf / k AS fdr FROM k)"""


@query(
    "bh_fdr",
    f"""{_FDR} SELECT gene_id, variant_id, k, {rnd("fdr", 9)} AS fdr FROM f
    WHERE k < coalesce((SELECT min(k) FROM f WHERE fdr > 0.01), 9223372036854775807)""",
)
def _(t):
    x = N.bh_fdr(leads(t), 0.01)
    return x.select("gene_id", "variant_id", "k", r("fdr", 9).alias("fdr"))


@query(
    "top_genes",
    f"{_FDR} SELECT gene_id, variant_id, k, {rnd('fdr', 9)} AS fdr FROM f WHERE k <= 25",
)
def _(t):
    x = N.top_genes(leads(t), 25)
    return x.select("gene_id", "variant_id", "k", r("fdr", 9).alias("fdr"))


@query(
    "log_normalize",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id,
    {rnd("ln(1 + 10000 * count / sum(count) OVER (PARTITION BY cell_id))")} AS value
    FROM counts""",
)
def _(t):
    x = N.log_normalize(S.counts(t))
    return x.select("cell_id", "gene_id", r("value").alias("value"))


@query(
    "normalize_pseudobulk",
    f"""{with_ctes("counts", "cells")}, pb AS (SELECT individual_id, cell_type, gene_id,
      sum(count) AS count FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3),
    e AS (SELECT *, ln(1 + 10000 * count / sum(count) OVER
      (PARTITION BY individual_id, cell_type)) AS v FROM pb),
    grid AS (SELECT d.individual_id, cell_type, g.gene_id, v FROM
      (SELECT DISTINCT individual_id, cell_type FROM pb) d JOIN
      (SELECT DISTINCT gene_id, cell_type FROM pb) g USING (cell_type)
      LEFT JOIN e USING (individual_id, cell_type, gene_id)),
    z AS (SELECT *, avg(coalesce(v, 0)) OVER w AS m, stddev_pop(coalesce(v, 0)) OVER w AS s
      FROM grid WINDOW w AS (PARTITION BY gene_id, cell_type))
    SELECT individual_id, cell_type, gene_id, {rnd("(v - m) / s", 4)} AS value,
      {rnd("-m / s", 4)} AS zero_value FROM z WHERE v IS NOT NULL""",
)
def _(t):
    key = ["individual_id", "cell_type"]
    pb = A.pseudobulk(S.counts(t), S.cells(t), key)
    z = N.normalize_pseudobulk(pb, sample=key, within=["cell_type"], zeros=True)
    return z.select(
        *key, "gene_id", r("value", 4).alias("value"), r("zero_value", 4).alias("zero_value")
    )


@query(
    "standardize_sparse",
    f"""{with_ctes("counts")}, n AS (SELECT count(DISTINCT cell_id) AS n FROM counts),
    s AS (SELECT gene_id, sum(count) / any_value(n) AS m,
      sqrt(sum(count * count) / any_value(n) - (sum(count) / any_value(n)) ** 2) AS s
      FROM counts, n GROUP BY 1)
    SELECT cell_id, gene_id, {rnd("(count - m) / s", 4)} AS value, {rnd("-m / s", 4)} AS zero_value
    FROM counts JOIN s USING (gene_id)""",
)
def _(t):
    c = S.counts(t)
    n = c.select("cell_id").distinct().count()
    z = N.standardize_sparse(c.withColumnRenamed("count", "value"), n)
    return z.select(
        "cell_id", "gene_id", r("value", 4).alias("value"), r("zero_value", 4).alias("zero_value")
    )


_PEARSON = f"""{with_ctes("counts")}, c AS (SELECT cell_id, sum(count) AS nc FROM counts GROUP BY 1),
    g AS (SELECT gene_id, sum(count) / (SELECT sum(count) FROM counts) AS p FROM counts GROUP BY 1),
    grid AS (SELECT cell_id, gene_id, nc, p, coalesce(count, 0) AS y FROM c CROSS JOIN g
      LEFT JOIN counts USING (cell_id, gene_id)),
    res AS (SELECT *, (y - nc * p) / sqrt(nc * p - nc * p * nc * p / nc) AS r FROM grid),
    st AS (SELECT gene_id, any_value(p) AS p, avg(r) AS m, stddev_pop(r) AS s FROM res GROUP BY 1)"""


@query(
    "pearson_residuals",
    f"""{_PEARSON} SELECT cell_id, gene_id, {rnd("(r - m) / s", 4)} AS value
    FROM res JOIN st USING (gene_id) WHERE y <> 0""",
)
def _(t):
    entries, _table = N.pearson_residuals(S.counts(t))
    return entries.withColumn("value", r("value", 4))


@query(
    "pearson_residual_zeros",
    f"""{_PEARSON} SELECT gene_id, {rnd("-sqrt(p / (1 - p))", 5)} AS zero_slope,
    {rnd("m", 4)} AS mean, {rnd("s", 4)} AS sd FROM st""",
)
def _(t):
    _entries, table = N.pearson_residuals(S.counts(t))
    return table.select(
        "gene_id", r("zero_slope", 5).alias("zero_slope"), r("mean", 4).alias("mean"),
        r("sd", 4).alias("sd"),
    )


@query(
    "log2_tpm",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id, {rnd("log2(count + 1)")} AS value
    FROM counts""",
)
def _(t):
    x = N.log2_tpm(S.counts(t).withColumnRenamed("count", "value"))
    return x.withColumn("value", r("value"))


# every part and every return flag with line number; a pair without a row is a zero
PB_MATRIX = """m AS (SELECT l_partkey AS gene_id, l_returnflag || l_linenumber AS sample_id,
    sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
    grid AS (SELECT gene_id, sample_id, coalesce(value, 0) AS value FROM
      (SELECT DISTINCT gene_id FROM m) CROSS JOIN (SELECT DISTINCT sample_id FROM m)
      LEFT JOIN m USING (gene_id, sample_id))"""


def pb_matrix(t):
    """A gene x sample matrix with gaps: sums by part, return flag and line number."""
    sample = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return t.lineitem.groupBy(F.col("l_partkey").alias("gene_id"), sample.alias("sample_id")).agg(
        F.sum("l_quantity").alias("value")
    )


@query(
    "quantile_normalize",
    f"""WITH {PB_MATRIX}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id
      ORDER BY value, gene_id) AS k FROM grid),
    q AS (SELECT k, avg(value) AS q FROM k GROUP BY 1),
    n AS (SELECT gene_id, sample_id, k.value, median(q) OVER (PARTITION BY sample_id, k.value) AS new
      FROM k JOIN q USING (k)),
    z AS (SELECT sample_id, any_value(new) AS zero FROM n WHERE value = 0 GROUP BY 1)
    SELECT n.gene_id, sample_id, {rnd("new", 5)} AS value, {rnd("zero", 5)} AS zero_value
    FROM n SEMI JOIN m USING (gene_id, sample_id) LEFT JOIN z USING (sample_id)""",
)
def _(t):
    x = N.quantile_normalize(pb_matrix(t), zero_value=True)
    return x.withColumns({c: r(c, 5) for c in ("value", "zero_value")})


_RANKS = f"""{with_ctes("counts")}, full_rows AS (SELECT cell_id, gene_id, coalesce(count, 0) AS count FROM
      (SELECT DISTINCT cell_id FROM counts) CROSS JOIN (SELECT DISTINCT gene_id FROM counts)
      LEFT JOIN counts USING (cell_id, gene_id)),
    k AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY count) AS lo,
      count(*) OVER (PARTITION BY gene_id, count) AS ties, count(*) OVER (PARTITION BY gene_id) AS n FROM full_rows),
    f AS (SELECT cell_id, gene_id, count, (lo + (ties - 1) / 2) / (n + 1) AS fraction FROM k),
    z AS (SELECT gene_id, any_value(fraction) AS zero FROM f WHERE count = 0 GROUP BY 1)"""


@query(
    "rank_fraction",
    f"""{_RANKS} SELECT cell_id, gene_id, {rnd("fraction", 10)} AS fraction,
      {rnd("zero", 10)} AS zero_fraction FROM f LEFT JOIN z USING (gene_id) WHERE count > 0""",
)
def _(t):
    c = S.counts(t)
    x = N.rank_fraction(c, value="count", n_samples=c.agg(F.count_distinct("cell_id")).scalar())
    return x.select(
        "cell_id", "gene_id", r("fraction", 10).alias("fraction"), r("zero_fraction", 10).alias("zero_fraction")
    )


def normal_quantile_sql(p: str) -> str:
    """A rational start, then Newton steps on the normal distribution function, which is summed
    as a series around zero."""
    t = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    # fixed values of a known approximation
    near = f"({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"
    x = f"(sign(({p}) - 0.5) * {near})"
    for _ in range(3):
        cdf = f"(0.5 + {series_sql('v')} * exp(-v * v / 2) / sqrt(2 * pi()))"
        x = f"list_transform([{x}], lambda v: v - ({cdf} - ({p})) / (exp(-v * v / 2) / sqrt(2 * pi())))[1]"
    return x


def series_sql(v: str) -> str:
    """v + v^3 / 3 + v^5 / (3 * 5) + ..., by Horner's rule."""
    out = "1"
    for i in range(60, 0, -1):
        out = f"(1 + {v} * {v} / {2 * i + 1} * {out})"
    return f"({v} * {out})"


@query(
    "inverse_normal",
    f"""{_RANKS}, d AS (SELECT DISTINCT fraction AS p FROM f),
    q AS (SELECT p, {normal_quantile_sql("p")} AS q FROM d)
    SELECT cell_id, f.gene_id, {rnd("q.q", 5)} AS value, {rnd("y.q", 5)} AS zero_value
    FROM f JOIN q ON q.p = f.fraction LEFT JOIN z USING (gene_id) LEFT JOIN q y ON y.p = z.zero WHERE count > 0""",
)
def _(t):
    c = S.counts(t)
    n = c.agg(F.count_distinct("cell_id")).scalar()
    x = N.inverse_normal(c.select("cell_id", "gene_id", F.col("count").alias("value")), n_samples=n)
    return x.select("cell_id", "gene_id", r("value", 5).alias("value"), r("zero_value", 5).alias("zero_value"))


_TMM = f"""WITH {PB_MATRIX}, tot AS (SELECT sample_id, sum(value) AS n FROM m GROUP BY 1),
    q AS (SELECT sample_id, quantile_cont(value, 0.75) / any_value(n) AS f
      FROM grid JOIN tot USING (sample_id) GROUP BY 1),
    ref AS (SELECT arg_min(sample_id, (abs(f - (SELECT avg(f) FROM q)), sample_id)) AS r FROM q),
    r0 AS (SELECT gene_id, value AS y0, n AS n0 FROM m JOIN tot USING (sample_id)
      WHERE sample_id = (SELECT r FROM ref)),
    x AS (SELECT sample_id, gene_id, log2((value / n) / (y0 / n0)) AS lr,
      0.5 * (log2(value / n) + log2(y0 / n0)) AS ab,
      (n - value) / n / value + (n0 - y0) / n0 / y0 AS v
      FROM m JOIN tot USING (sample_id) JOIN r0 USING (gene_id)),
    k AS (SELECT *, count(*) OVER s AS n,
      rank() OVER (PARTITION BY sample_id ORDER BY lr)
        + (count(*) OVER (PARTITION BY sample_id, lr) - 1) / 2 AS rr,
      rank() OVER (PARTITION BY sample_id ORDER BY ab)
        + (count(*) OVER (PARTITION BY sample_id, ab) - 1) / 2 AS ra
      FROM x WINDOW s AS (PARTITION BY sample_id)),
    w AS (SELECT sample_id, sum(lr / v) / sum(1 / v) AS l FROM k
      WHERE rr BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3)
        AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY 1),
    tmm AS (SELECT sample_id, 2 ** (l - (SELECT avg(l) FROM w)) AS tmm FROM w)"""


@query("tmm_factors", f"{_TMM} SELECT sample_id, {rnd('tmm')} AS tmm FROM tmm")
def _(t):
    m = pb_matrix(t).withColumnRenamed("value", "count")
    return N.tmm_factors(m).withColumn("tmm", r("tmm"))


@query(
    "cpm_tmm",
    f"""{_TMM} SELECT gene_id, sample_id, {rnd("value / (n * tmm) * 1000000", 4)} AS cpm
    FROM m JOIN tot USING (sample_id) JOIN tmm USING (sample_id)""",
)
def _(t):
    m = pb_matrix(t).withColumnRenamed("value", "count")
    x = N.cpm(m, N.tmm_factors(m))
    return x.select("gene_id", "sample_id", r("cpm", 4).alias("cpm"))


@query(
    "cpm",
    f"""{with_ctes("counts")} SELECT cell_id, gene_id,
    {rnd("count / sum(count) OVER (PARTITION BY cell_id) * 1000000", 4)} AS cpm FROM counts""",
)
def _(t):
    x = N.cpm(S.counts(t), sample="cell_id")
    return x.select("cell_id", "gene_id", r("cpm", 4).alias("cpm"))


@query(
    "sample_cells_independent",
    f"""{with_ctes("cells")} SELECT cell_id FROM cells WHERE
    CAST(('0x' || substr(md5('3|' || cell_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 < 0.3""",
)
def _(t):
    return Fi.sample_cells(S.cells(t), 0.3, 3, exact=False).select("cell_id")
