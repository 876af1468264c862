"""Allele-count operators on the driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.q_basic import r, rnd
from checks.registry import query
from checks.standins import with_ctes
from varloom.operators import allelic as L
from varloom.operators import filters as Fi
from varloom.operators import normalize as N

_MIN = "least(allele_count, total_count - allele_count)"
_MONO = f"CASE WHEN total_count < 3 OR {_MIN} / total_count < 0.01 THEN 1.0 ELSE 0.0 END"


@query(
    "filter_ase_sites",
    f"""{with_ctes("ase")} SELECT * FROM ase WHERE site_id IN (SELECT site_id FROM ase GROUP BY 1
    HAVING count(*) >= 0.002 * (SELECT count(DISTINCT sample_id) FROM ase)
      AND avg({_MONO}) <= 0.3)""",
)
def _(t):
    return Fi.filter_ase_sites(S.ase(t), min_fraction=0.002, max_monoallelic=0.3)


@query(
    "filter_nonzero_cells",
    f"""{with_ctes("ase")} SELECT * FROM ase WHERE sample_id IN
    (SELECT sample_id FROM ase WHERE total_count >= 40)""",
)
def _(t):
    return Fi.filter_nonzero_cells(S.ase(t), 40)


@query(
    "filter_high_biallelic",
    f"""{with_ctes("ase")} SELECT * FROM ase WHERE sample_id IN (SELECT sample_id FROM ase
    GROUP BY 1 HAVING count(*) FILTER (total_count >= 10 AND {_MIN} > 0) >= 3 AND
    count(*) FILTER (total_count >= 10 AND {_MIN} > 0) / count(*) FILTER (total_count >= 10) > 0.7)""",
)
def _(t):
    return Fi.filter_high_biallelic(S.ase(t), min_sites=3, min_fraction=0.7)


@query(
    "remove_outlier_genes",
    f"""{with_ctes("ase")} SELECT * FROM ase WHERE site_id IN (SELECT site_id FROM ase GROUP BY 1
    HAVING 2 * (count(*) FILTER (allele_count / total_count < 0.2)
      + count(*) FILTER (allele_count / total_count > 0.8)) <= count(*))""",
)
def _(t):
    return Fi.remove_outlier_genes(S.ase(t), gene="site_id", low=0.2, high=0.8)


@query("mask_low_depth", f"{with_ctes('ase')} SELECT * FROM ase WHERE total_count >= 20")
def _(t):
    return Fi.mask_low_depth(S.ase(t), 20)


@query(
    "site_depth",
    f"""{with_ctes("ase")} SELECT site_id, CAST(sum(total_count) AS BIGINT) AS depth
    FROM ase GROUP BY 1""",
)
def _(t):
    return L.site_depth(S.ase(t))


@query(
    "one_site_per_gene",
    f"""{with_ctes("ase", "sites")}, d AS (SELECT site_id, gene_id, sum(total_count) AS depth
      FROM ase JOIN sites USING (site_id) GROUP BY 1, 2)
    SELECT * FROM ase WHERE site_id IN (SELECT site_id FROM (SELECT site_id, row_number() OVER
      (PARTITION BY gene_id ORDER BY depth DESC, site_id) AS k FROM d) WHERE k = 1)""",
)
def _(t):
    sites = S.sites(t).select("site_id", "gene_id", F.col("site_id").alias("ordinal"))
    return L.one_site_per_gene(S.ase(t), sites)


@query(
    "min_allele",
    f"""{with_ctes("ase")} SELECT site_id, sample_id, {_MIN} AS allele_count, total_count
    FROM ase""",
)
def _(t):
    return L.min_allele(S.ase(t))


@query(
    "cap_depth",
    f"""{with_ctes("ase")} SELECT site_id, sample_id, CAST(CASE WHEN total_count > 16 THEN
    round_even(16 * allele_count / total_count, 0) ELSE allele_count END AS INTEGER)
    AS allele_count, CAST(least(total_count, 16) AS INTEGER) AS total_count FROM ase""",
)
def _(t):
    return L.cap_depth(S.ase(t), 16)


_RATIO = f"""{with_ctes("ase")}, x AS (SELECT site_id, sample_id,
      allele_count / total_count AS r FROM ase),
    z AS (SELECT *, CASE WHEN stddev_pop(r) OVER w > 1e-9 THEN (r - avg(r) OVER w)
      / stddev_pop(r) OVER w END AS z FROM x WINDOW w AS (PARTITION BY site_id))"""


@query(
    "scale_ratios",
    f"{_RATIO} SELECT site_id, sample_id, {rnd('z', 4)} AS scaled_ratio FROM z",
)
def _(t):
    z = L.scale_ratios(S.ase(t))
    return z.select("site_id", "sample_id", r("scaled_ratio", 4).alias("scaled_ratio"))


def with_donor(t):
    return S.ase(t).join(
        S.cells(t).select(F.col("cell_id").alias("sample_id"), "individual_id"), "sample_id"
    )


_DONOR = """d AS (SELECT o_orderkey AS sample_id, c_nationkey AS individual_id
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "regress_out_groups",
    f"""{_RATIO}, {_DONOR}, res AS (SELECT site_id, sample_id,
      z - avg(z) OVER (PARTITION BY site_id, individual_id) AS e FROM z JOIN d USING (sample_id)
      WHERE z IS NOT NULL)
    SELECT site_id, sample_id, {rnd('CASE WHEN stddev_pop(e) OVER w > 1e-9 THEN e / stddev_pop(e) OVER w END', 4)}
      AS scaled_ratio FROM res WINDOW w AS (PARTITION BY site_id)""",
)
def _(t):
    z = L.regress_out_groups(L.scale_ratios(with_donor(t)))
    return z.select("site_id", "sample_id", r("scaled_ratio", 4).alias("scaled_ratio"))


_PHASE = f"""{with_ctes("ase")}, {_DONOR}, ph AS (SELECT site_id, individual_id,
      CASE WHEN sum(total_count) = 0 THEN 'missing'
        WHEN 2 * sum(allele_count) <= sum(total_count) THEN 'correct' ELSE 'flipped' END AS phase
      FROM ase JOIN d USING (sample_id) GROUP BY 1, 2)"""


@query("phase_by_individual", f"{_PHASE} SELECT * FROM ph")
def _(t):
    return L.phase_by_individual(with_donor(t))


def binned(t):
    cells = S.cells(t).select(F.col("cell_id").alias("sample_id"), "pseudotime")
    bins = N.equal_bins(cells, "pseudotime", 5, tie="sample_id").drop("pseudotime")
    return with_donor(t).join(bins, "sample_id")


_BINS = """b AS (SELECT cell_id AS sample_id,
    CAST(greatest((k * 5 + n - 1) // n - 1, 0) AS INTEGER) AS bin
    FROM (SELECT o_orderkey AS cell_id, count(*) OVER () AS n,
      row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k FROM orders))"""
_SUMS = """SELECT site_id, bin, CAST(sum({x}) AS BIGINT) AS allele_count,
    CAST(sum(total_count) AS BIGINT) AS total_count FROM ase JOIN b USING (sample_id)"""


@query("sum_by_bin_min", f"{with_ctes('ase')}, {_BINS} {_SUMS.format(x=_MIN)} GROUP BY 1, 2")
def _(t):
    return L.sum_by_bin(binned(t), "bin", mode="min")


@query("sum_by_bin_raw", f"{with_ctes('ase')}, {_BINS} {_SUMS.format(x='allele_count')} GROUP BY 1, 2")
def _(t):
    return L.sum_by_bin(binned(t), "bin", mode="raw")


@query(
    "sum_by_bin_line_min",
    f"""{_PHASE}, {_BINS} {_SUMS.format(x='''CASE WHEN phase = 'flipped'
      THEN total_count - allele_count ELSE allele_count END''')}
    JOIN d USING (sample_id) JOIN ph USING (site_id, individual_id) GROUP BY 1, 2""",
)
def _(t):
    return L.sum_by_bin(binned(t), "bin", mode="line_min")


@query(
    "bin_measures",
    f"""{with_ctes('ase')}, {_BINS}, s AS ({_SUMS.format(x=_MIN)} GROUP BY 1, 2)
    SELECT site_id, bin, {rnd("allele_count / total_count")} AS fraction, total_count AS depth,
    {rnd("log2(total_count + 1)")} AS log_depth FROM s""",
)
def _(t):
    m = L.bin_measures(L.sum_by_bin(binned(t), "bin"))
    return m.select(
        "site_id", "bin", r("fraction").alias("fraction"), "depth", r("log_depth").alias("log_depth")
    )


@query(
    "depth_summary",
    f"""{with_ctes("ase")} SELECT sample_id, count(*) FILTER (total_count >= 3) AS sites_3,
    count(*) FILTER (total_count >= 5) AS sites_5, count(*) FILTER (total_count >= 10) AS sites_10,
    count(*) FILTER (total_count >= 15) AS sites_15,
    count(*) FILTER (total_count >= 3 AND {_MIN} > 0) AS biallelic FROM ase GROUP BY 1""",
)
def _(t):
    return L.depth_summary(S.ase(t))


@query(
    "biallelic_summary",
    f"""{with_ctes("ase")}, s AS (SELECT sample_id, count(*) FILTER (total_count >= 10) AS e,
      count(*) FILTER (total_count >= 10 AND {_MIN} > 0) AS b, sum({_MIN}) AS m,
      sum(total_count) AS n FROM ase GROUP BY 1)
    SELECT sample_id, e AS n_expressed, b AS n_biallelic,
    {rnd("CASE WHEN e > 0 THEN b / e END")} AS fraction_biallelic,
    {rnd("m / n")} AS global_allelic_fraction FROM s""",
)
def _(t):
    s = L.biallelic_summary(S.ase(t))
    return s.withColumns(
        {c: r(c) for c in ("fraction_biallelic", "global_allelic_fraction")}
    )


@query(
    "global_fraction",
    f"""{with_ctes("ase")} SELECT sample_id,
    {rnd("sum(allele_count) / sum(total_count)")} AS global_fraction FROM ase GROUP BY 1""",
)
def _(t):
    return L.global_fraction(S.ase(t)).withColumn("global_fraction", r("global_fraction"))


@query(
    "batch_summary",
    f"""{with_ctes("ase", "counts")}, c AS (SELECT sample_id AS cell_id, total_count AS n,
      total_count - allele_count AS ref, allele_count AS alt FROM ase),
    l AS (SELECT cell_id, sum(count) AS library_size FROM counts WHERE count > 30 GROUP BY 1)
    SELECT c.cell_id, count(*) FILTER (n >= 1) AS sites_1, count(*) FILTER (n >= 2) AS sites_2,
    count(*) FILTER (n >= 3) AS sites_3, count(*) FILTER (n >= 4) AS sites_4,
    count(*) FILTER (n >= 5) AS sites_5, count(*) FILTER (ref > 0 AND alt > 0) AS biallelic,
    any_value(library_size) AS library_size FROM c LEFT JOIN l USING (cell_id) GROUP BY 1""",
)
def _(t):
    counter = S.ase(t).select(
        F.col("sample_id").alias("cell_id"),
        (F.col("total_count") - F.col("allele_count")).alias("ref_count"),
        F.col("allele_count").alias("alt_count"),
    )
    from varloom.operators.aggregates import library_size

    return L.batch_summary(counter, library_size(S.counts(t).where("count > 30")))


@query(
    "sample_match_score",
    f"""WITH a AS (SELECT l_suppkey AS site_id, l_orderkey AS sample_id,
      sum(least(CAST(l_quantity AS INTEGER), l_linenumber * 4)) AS allele_count,
      sum(CAST(l_quantity AS INTEGER)) AS total_count FROM lineitem GROUP BY 1, 2),
    {with_ctes("genotype")[5:]}
    SELECT sample_id, individual_id, count(*) FILTER (({_MIN} > 0) = (dosage = 1)) AS n_match,
    count(*) AS n_sites, {rnd(f"count(*) FILTER (({_MIN} > 0) = (dosage = 1)) / count(*)")} AS score
    FROM a JOIN genotype ON a.site_id = variant_id WHERE total_count >= 10 AND dosage IS NOT NULL
    GROUP BY 1, 2""",
)
def _(t):
    q = F.col("l_quantity").cast("int")
    a = t.lineitem.groupBy(
        F.col("l_suppkey").alias("site_id"), F.col("l_orderkey").alias("sample_id")
    ).agg(
        F.sum(F.least(q, F.col("l_linenumber") * 4)).alias("allele_count"),
        F.sum(q).alias("total_count"),
    )
    g = S.genotype(t).withColumnRenamed("variant_id", "site_id")
    return L.sample_match_score(a, g).withColumn("score", r("score"))


@query(
    "allele_counts",
    """WITH o AS (SELECT l_orderkey AS cell_id, l_suppkey AS site_id, l_returnflag AS base,
      CAST(l_quantity AS INTEGER) AS base_quality, l_linenumber * 10 AS map_quality FROM lineitem),
    h AS (SELECT s_suppkey AS site_id, 'A' AS ref, 'R' AS alt FROM supplier
      WHERE s_nationkey % 3 = 1),
    c AS (SELECT cell_id, site_id,
      count(*) FILTER (map_quality >= 20 AND base_quality >= 10 AND base = ref) AS ref_count,
      count(*) FILTER (map_quality >= 20 AND base_quality >= 10 AND base = alt) AS alt_count,
      count(*) FILTER (map_quality >= 20 AND base_quality >= 10 AND base <> ref AND base <> alt)
        AS other_bases,
      count(*) FILTER (map_quality < 20) AS low_mapq_depth,
      count(*) FILTER (map_quality >= 20 AND base_quality < 10) AS low_baseq_depth,
      count(*) AS raw_depth FROM o JOIN h USING (site_id) GROUP BY 1, 2)
    SELECT *, ref_count + alt_count AS total_count FROM c WHERE ref_count + alt_count >= 1""",
)
def _(t):
    o = t.lineitem.select(
        F.col("l_orderkey").alias("cell_id"),
        F.col("l_suppkey").alias("site_id"),
        F.col("l_returnflag").alias("base"),
        F.col("l_quantity").cast("int").alias("base_quality"),
        (F.col("l_linenumber") * 10).alias("map_quality"),
    )
    g = t.supplier.select(
        F.col("s_suppkey").alias("site_id"),
        F.lit("A").alias("ref"),
        F.lit("R").alias("alt"),
        (F.col("s_nationkey") % 3).cast("double").alias("dosage"),
    )
    return L.allele_counts(o, g, min_map_quality=20)


@query(
    "dedup_random",
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, event_type ORDER BY md5(concat_ws('|', '5', event_id)), event_id) AS k
    FROM events) WHERE k = 1""",
)
def _(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return L.dedup_random(e, ["user_id", "event_type"], seed=5, read_id="event_id")


@query(
    "rows_for_barcodes",
    """SELECT event_id, user_id, value FROM events WHERE user_id IN
    (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    listed = t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id")
    )
    return L.rows_for_barcodes(
        t.events.select("event_id", "user_id", "value"), listed, barcode="user_id"
    )
