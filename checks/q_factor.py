"""Count models, decompositions and factor models on the driver tables.

Fits run over the whole tables until they settle. Beside them a few steps of the one-factor
models are compared with SQL in which the steps are written out one after another; the other
options are tested against dense computations in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.q_basic import r, rnd
from checks.q_models import gene_rows
from checks.registry import query, solved_sql
from checks.standins import with_ctes
from varloom.functions import special
from varloom.operators import allelic as L
from varloom.operators import ase_factorization as E
from varloom.operators import count_models as C
from varloom.operators import decomposition as D
from varloom.operators import factorization as X
from varloom.operators import normalize as N
from varloom.operators import regression as M
from varloom.plans.scale import bucketed, buckets_for, cut_lineage


def factor_obs(t):
    """Customers as samples and brands as tests: standardised price on standardised discount."""
    rows = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("p_brand").alias("test"), F.col("o_custkey").alias("sample"))
        .agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("g"))
    )
    z = N.standardize(cut_lineage(rows), by=["test"], value="y")
    return cut_lineage(N.standardize(z, by=["test"], value="g"))


def factor_samples(t):
    return t.customer.select(
        F.col("c_custkey").alias("sample"),
        F.col("c_nationkey").alias("donor"),
        F.col("c_mktsegment").alias("segment"),
        F.array((F.col("c_acctbal") / 10_000).cast("double")).alias("c"),
    )


OBS = """r AS (SELECT p_brand AS test, o_custkey AS sample, avg(l_extendedprice) AS y0, avg(l_discount) AS g0
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    obs AS MATERIALIZED (SELECT test, sample, (y0 - avg(y0) OVER w) / stddev_pop(y0) OVER w AS y,
      (g0 - avg(g0) OVER w) / stddev_pop(g0) OVER w AS g FROM r WINDOW w AS (PARTITION BY test))"""


def uniform_sql(key: str, first: int = 1) -> str:
    """The number that ``hash_order`` gives for a key, from eight digits of its hash."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', {key})), {first}, 8)) AS BIGINT)::DOUBLE"


def normal_sql(seed: int, key: str) -> str:
    name = f"'{seed * 1009}', {key}"
    u1, u2 = uniform_sql(name), uniform_sql(name, 9)
    return f"sqrt(-2 * ln(({u1} + 1) / 4294967297)) * cos(2 * pi() * {u2} / 4294967296)"


@query("grouped_negbin")
def _(t):
    rows = gene_rows(t).withColumn("library_size", F.col("price"))
    return C.grouped_negbin(rows, ["gene_id"], y="quantity", covariates=["tax"])


def brand_ase(t):
    q = F.col("l_quantity").cast("int")
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("p_brand").alias("site_id"),
            F.col("o_custkey").alias("sample_id"),
            F.col("c_nationkey").alias("individual_id"),
        )
        .agg(
            F.sum(F.least(q, F.col("l_linenumber") * 4)).cast("int").alias("allele_count"),
            F.sum(q).cast("int").alias("total_count"),
        )
    )


@query(
    "allelic_mean_binomial",
    f"""{with_ctes("ase")} SELECT site_id,
    {rnd("sum(least(allele_count, total_count - allele_count)) / sum(total_count)")} AS mean
    FROM ase WHERE total_count > 1 GROUP BY 1""",
)
def _(t):
    m = C.grouped_allelic_mean(S.ase(t), ["site_id"], family="binomial")
    return m.withColumn("mean", r("mean"))


def _folded_sql(steps: int) -> str:
    """Halvings of the interval that holds the fraction, by the sign of the likelihood's slope."""
    parts = ["""ase AS (SELECT p_brand AS site_id, o_custkey AS sample_id, c_nationkey AS individual_id,
        CAST(sum(least(CAST(l_quantity AS INTEGER), l_linenumber * 4)) AS INTEGER) AS a,
        CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
      e AS MATERIALIZED (SELECT site_id, least(a, n - a) AS y, n, count(*) AS w FROM ase WHERE n > 1 GROUP BY ALL),
      s0 AS (SELECT DISTINCT site_id, 0.001::DOUBLE AS lo, 0.49999::DOUBLE AS hi FROM e)"""]
    for i in range(steps):
        parts.append(f"""g{i} AS (SELECT site_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS p,
          sum(w * ((y / ((lo + hi) / 2) - (n - y) / (1 - (lo + hi) / 2))
            + exp((n - 2 * y) * ln((lo + hi) / (2 - lo - hi))) * ((n - y) / ((lo + hi) / 2) - y / (1 - (lo + hi) / 2)))
            / (1 + exp((n - 2 * y) * ln((lo + hi) / (2 - lo - hi))))) AS slope FROM e JOIN s{i} USING (site_id) GROUP BY 1),
        s{i + 1} AS MATERIALIZED (SELECT site_id, CASE WHEN slope > 0 THEN p ELSE lo END AS lo,
          CASE WHEN slope > 0 THEN hi ELSE p END AS hi FROM g{i})""")
    return "WITH " + ", ".join(parts)


@query(
    "allelic_mean_folded",
    f"""{_folded_sql(40)} SELECT site_id, {rnd("(lo + hi) / 2", 4)} AS mean, true AS converged FROM s40""",
)
def _(t):
    m = C.grouped_allelic_mean(brand_ase(t), ["site_id"], family="folded_binomial")
    return m.select("site_id", r("mean", 4).alias("mean"), "converged")


@query("allelic_mean_beta_binomial")
def _(t):
    return C.grouped_allelic_mean(brand_ase(t), ["site_id"], family="beta_binomial")


@query("allelic_mean_folded_beta_binomial")
def _(t):
    return C.grouped_allelic_mean(brand_ase(t), ["site_id"], family="folded_beta_binomial")


def log_counts(t):
    return N.log_normalize(S.counts(t)).select("cell_id", "gene_id", "value")


def _power_sql(steps: int) -> str:
    """Power steps over the cells by genes of ``x``, one after another."""
    parts = ["w0 AS MATERIALIZED (SELECT gene_id, 1.0 AS w FROM (SELECT DISTINCT gene_id FROM x))"]
    for i in range(steps):
        parts.append(f"""y{i} AS MATERIALIZED (SELECT cell_id, sum(value * w) AS y FROM x JOIN w{i} USING (gene_id) GROUP BY 1),
        z{i} AS MATERIALIZED (SELECT gene_id, sum(value * y) AS z FROM x JOIN y{i} USING (cell_id) GROUP BY 1),
        w{i + 1} AS MATERIALIZED (SELECT gene_id, z / sqrt(sum(z * z) OVER ()) AS w FROM z{i})""")
    last = f"l AS (SELECT cell_id, sum(value * w) AS y FROM x JOIN w{steps} USING (gene_id) GROUP BY 1)"
    return ", ".join([*parts, last])


_PCA = f"""{with_ctes("counts")}, x AS MATERIALIZED (SELECT cell_id, gene_id,
      ln(1 + 10000 * count / sum(count) OVER (PARTITION BY cell_id)) AS value FROM counts), {_power_sql(40)}"""


@query(
    "pca",
    f"""{_PCA} SELECT cell_id, {rnd("y / sqrt(sum(y * y) OVER ())", 4)} AS pc FROM l""",
)
def _(t):
    scores = D.pca(log_counts(t), 5)[0]
    # the sign is that of the largest gene weight, which is positive in the first component
    return scores.select("cell_id", r(F.col("pcs")[0], 4).alias("pc"))


@query("pca_components")
def _(t):
    return D.pca(log_counts(t), 5)[0]


@query(
    "pca_variance",
    f"""{_PCA} SELECT 0 AS component, round((SELECT sum(y * y) FROM l) / (SELECT sum(value * value) FROM x), 7) + 0.0
    AS variance_explained""",
)
def _(t):
    shares = D.pca(log_counts(t), 5)[1].where("component = 0")
    return shares.withColumn("variance_explained", r("variance_explained", 7))


@query("pca_variance_all")
def _(t):
    return D.pca(log_counts(t), 5)[1]


@query("pca_pearson_residuals")
def _(t):
    counts = cut_lineage(S.counts(t))  # the sums, the entries and the zeros read it, by cell
    counts = bucketed(counts, "cell_id", buckets_for(counts.count(), t.spark), replaces=counts)
    entries, table = N.pearson_residuals(counts)
    return D.pca(entries, 3, zeros=N.pearson_zero_terms(counts, table))[0]


@query("gene_set_scores")
def _(t):
    sets = t.part.groupBy(F.col("p_name").alias("set_id")).agg(
        F.collect_set(S.gene_key()).alias("genes")
    )
    return D.gene_set_scores(log_counts(t), sets)


def _module_sql(name: str, numbers: range, size: int) -> str:
    """The score of one gene set: its mean less that of controls from the bins of its genes."""
    genes = ", ".join(f"'Brand#{i}_ECONOMY'" for i in numbers)
    return f"""{name}_bins AS (SELECT DISTINCT bin FROM binned WHERE gene_id IN ({genes})),
    {name}_w AS (SELECT gene_id, 1 AS side FROM binned WHERE gene_id IN ({genes}) UNION ALL
      SELECT gene_id, 0 FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('0|' || gene_id), gene_id) AS k
        FROM binned JOIN {name}_bins USING (bin)) WHERE k <= {size} AND gene_id NOT IN ({genes})),
    {name} AS (SELECT cell_id, coalesce(sum(value * CASE side
      WHEN 1 THEN 1.0::DOUBLE / (SELECT count(*) FROM {name}_w WHERE side = 1)
      WHEN 0 THEN -1.0::DOUBLE / (SELECT count(*) FROM {name}_w WHERE side = 0) END), 0) AS score
      FROM x LEFT JOIN {name}_w USING (gene_id) GROUP BY 1)"""


@query(
    "score_cell_cycle",
    f"""{with_ctes("counts")}, x AS (SELECT cell_id, gene_id,
      ln(1 + 10000 * count / sum(count) OVER (PARTITION BY cell_id)) AS value FROM counts),
    m AS (SELECT gene_id, sum(value) / (SELECT count(DISTINCT cell_id) FROM x) AS mean FROM x GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY mean, gene_id) AS k FROM m),
    binned AS (SELECT gene_id, floor(min(k) OVER (PARTITION BY mean)
      / greatest(round_even((SELECT count(*) FROM m) / 24.0, 0), 1)) AS bin FROM o),
    {_module_sql("s", range(1, 9), 8)}, {_module_sql("g", range(10, 20), 8)}
    SELECT cell_id, {rnd("s.score", 5)} AS s_score, {rnd("g.score", 5)} AS g2m_score,
      CASE WHEN s.score < 0 AND g.score < 0 THEN 'G1' WHEN g.score > s.score THEN 'G2M' ELSE 'S' END AS phase
    FROM s JOIN g USING (cell_id)""",
)
def _(t):
    s = [f"Brand#{i}_ECONOMY" for i in range(1, 9)]
    g2m = [f"Brand#{i}_ECONOMY" for i in range(10, 20)]
    x = cut_lineage(log_counts(t))
    out = D.score_cell_cycle(x, s, g2m, x.select("cell_id").distinct().count())
    return out.withColumns({c: r(c, 5) for c in ("s_score", "g2m_score")})


@query("ppca_missing")
def _(t):
    return D.ppca_missing(L.scale_ratios(brand_ase(t)), 2, iterations=200, tolerance=1e-3)[0]


@query(
    "combat",
    f"""{with_ctes("counts", "cells").replace("WITH", "WITH RECURSIVE", 1)}, x AS (SELECT cell_id, gene_id,
      ln(1 + 10000 * count / sum(count) OVER (PARTITION BY cell_id)) AS value FROM counts),
    nb AS (SELECT batch, count(*)::DOUBLE AS n FROM cells GROUP BY 1),
    st AS (SELECT gene_id, batch, sum(value) AS s, sum(value * value) AS ss FROM x JOIN cells USING (cell_id) GROUP BY 1, 2),
    by_batch AS (SELECT gene_id, batch, n, coalesce(s, 0) / n AS m, coalesce(ss, 0) / n - (coalesce(s, 0) / n) ** 2 AS v
      FROM (SELECT DISTINCT gene_id FROM st) CROSS JOIN nb LEFT JOIN st USING (gene_id, batch)),
    pooled AS (SELECT gene_id, sum(n * m) / sum(n) AS grand, sqrt(sum(n * v) / sum(n)) AS sd FROM by_batch GROUP BY 1),
    sc AS (SELECT gene_id, batch, n, grand, sd, (m - grand) / sd AS gh, v * n / (n - 1) / (sd * sd) AS dh
      FROM by_batch JOIN pooled USING (gene_id) WHERE sd > 0 AND n > 1),
    pr AS (SELECT batch, avg(gh) AS gb, var_samp(gh) AS t2, (2 * var_samp(dh) + avg(dh) ** 2) / var_samp(dh) AS a,
      (avg(dh) * var_samp(dh) + avg(dh) ** 3) / var_samp(dh) AS b FROM sc GROUP BY 1),
    it AS (SELECT gene_id, batch, n, grand, sd, gh, dh, gb, t2, a, b, gh AS g, dh AS d, 0 AS i FROM sc JOIN pr USING (batch)
      UNION ALL SELECT gene_id, batch, n, grand, sd, gh, dh, gb, t2, a, b, (t2 * n * gh + d * gb) / (t2 * n + d),
        (0.5 * ((n - 1) * dh + n * (gh - (t2 * n * gh + d * gb) / (t2 * n + d)) ** 2) + b) / (n / 2 + a - 1), i + 1
      FROM it WHERE i < 60)
    SELECT gene_id, cell_id, batch, {rnd("((value - grand) / sd - g) / sqrt(d) * sd + grand", 4)} AS value,
      {rnd("((0 - grand) / sd - g) / sqrt(d) * sd + grand", 4)} AS zero_value
    FROM x JOIN cells USING (cell_id) JOIN (SELECT * FROM it WHERE i = 60) USING (gene_id, batch)""",
)
def _(t):
    out = D.combat(log_counts(t), S.cells(t).select("cell_id", "batch"), zeros=True)
    return out.withColumns({c: r(c, 4) for c in ("value", "zero_value")})


def als(t, k=3, iterations=1000, tolerance=1e-3, **choices):
    return X.eqtl_als(
        factor_obs(t), factor_samples(t), k, iterations=iterations, tolerance=tolerance, **choices
    )


@query("eqtl_als")
def _(t):
    return als(t)[0]


@query("eqtl_als_three_steps")
def _(t):
    return als(t, 3, 3, None)[0]


@query("eqtl_als_simplex")
def _(t):
    return als(t, u="simplex", weight_by_usage=True)[0]


@query("eqtl_als_signed")
def _(t):
    return als(t, u="lasso", genotype_intercept=False)[1]


def als_sql(steps: int, *, positive: bool = True, shared: bool = True, usage: bool = False) -> str:
    """Steps of alternating least squares with one factor, written out."""
    lam = 1e-4
    parts = [OBS, f"""u0 AS MATERIALIZED (SELECT c_custkey AS sample,
      {uniform_sql("'0', c_custkey")} / 4294967296 AS u FROM customer)"""]
    for i in range(steps):
        weight = f"(SELECT avg(u) FROM u{i})" if usage else "1.0"
        gram = [["n", "sg", "sgu"], ["sg", "sgg", "sggu"], ["sgu", "sggu", f"sgguu + n * {lam} * uw"]]
        right = ["sy", "sgy", "sguy"]
        if shared:
            base, f, v = solved_sql(gram, right)
        else:
            base, v = solved_sql([[gram[a][b] for b in (0, 2)] for a in (0, 2)], [right[0], right[2]])
            f = "0.0"
        bound = f"m * {lam}"
        new = f"sign(b) * greatest(abs(b) - {bound}, 0)"
        new = f"greatest({new}, 0)" if positive else new
        parts.append(f"""s{i} AS (SELECT test, {weight} AS uw, count(*) AS n, sum(g) AS sg, sum(g * u) AS sgu,
          sum(g * g) AS sgg, sum(g * g * u) AS sggu, sum(g * g * u * u) AS sgguu, sum(y) AS sy, sum(g * y) AS sgy,
          sum(g * u * y) AS sguy FROM obs JOIN u{i} USING (sample) GROUP BY test),
        t{i} AS MATERIALIZED (SELECT test, {base} AS base, {f} AS f, {v} AS v FROM s{i}),
        x{i} AS (SELECT sample, sum(g * g * v * v) AS a, sum(g * v * (y - base - g * f)) AS b, count(*) AS m
          FROM obs JOIN t{i} USING (test) GROUP BY 1),
        u{i + 1} AS MATERIALIZED (SELECT sample, CASE WHEN a > 0 THEN {new} / a ELSE 0 END AS u FROM x{i})""")
    return "WITH " + ", ".join(parts)


@query("eqtl_als_steps", f"{als_sql(2)} SELECT sample, {rnd('u', 4)} AS u FROM u2")
def _(t):
    u = als(t, 1, 2, None)[0]
    return u.select("sample", r(F.col("u")[0], 4).alias("u"))


@query(
    "eqtl_als_usage_steps",
    f"{als_sql(2, usage=True)} SELECT test, {rnd('base', 5)} AS intercept, {rnd('f', 5)} AS f, {rnd('v', 4)} AS v FROM t1",
)
def _(t):
    m = als(t, 1, 2, None, weight_by_usage=True)[1]
    return m.select("test", r("intercept", 5).alias("intercept"), r("f", 5).alias("f"), r(F.col("v")[0], 4).alias("v"))


@query(
    "eqtl_als_signed_steps",
    f"{als_sql(2, positive=False, shared=False)} SELECT sample, {rnd('u', 4)} AS u FROM u2",
)
def _(t):
    u = als(t, 1, 2, None, u="lasso", genotype_intercept=False)[0]
    return u.select("sample", r(F.col("u")[0], 4).alias("u"))


def vi(t, k=3, iterations=600, tolerance=1e-3, **choices):
    return X.eqtl_vi(
        factor_obs(t), factor_samples(t), k, iterations=iterations, tolerance=tolerance, **choices
    )


def vi_sql(steps: int, grouped: bool) -> str:
    """Steps of the variational model with one factor, written out; with ``grouped`` also the
    random intercepts of the samples' nation. The inclusion odds stay as they start."""
    odds = float(special.digamma(10.0) - special.digamma(1.0))
    shape = 1e-3
    parts = [OBS, f"""raw AS (SELECT c_custkey AS sample, c_nationkey AS z, {normal_sql(1, "c_custkey")} AS x FROM customer),
      u0 AS MATERIALIZED (SELECT sample, z, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS u, 1.0 AS u2 FROM raw),
      t0 AS MATERIALIZED (SELECT test, 0.0 AS m0, coalesce(regr_slope(y, g), 0) AS m1, {normal_sql(3, "test")} AS m2,
        1.0 AS tau, 1.0 AS psi FROM obs GROUP BY test),
      t0v AS MATERIALIZED (SELECT *, m2 * m2 + 1 AS q2 FROM t0),
      a0 AS MATERIALIZED (SELECT DISTINCT test, z, 0.0 AS alpha FROM obs JOIN u0 USING (sample))"""]
    for i in range(steps):
        alpha = "alpha" if grouped else "0.0"
        level = f"JOIN a{i} USING (test, z)" if grouped else ""
        parts.append(f"""b{i} AS (SELECT sample, sum(tau * g * g * q2) AS a,
          sum(tau * g * m2 * (y - m0 - g * m1 - {alpha})) AS b
          FROM obs JOIN u{i} USING (sample) JOIN t{i}v USING (test) {level} GROUP BY 1),
        c{i} AS (SELECT sample, z, b / (a + 1) AS mu, 1 / (a + 1) AS v,
          1 / (1 + exp(-({odds} - 0.5 * ln(a + 1) + b * b / (2 * (a + 1))))) AS s FROM b{i} JOIN u0 USING (sample)),
        u{i + 1} AS MATERIALIZED (SELECT sample, z, mu * s AS u, s * (mu * mu + v) AS u2 FROM c{i}),
        l{i} AS MATERIALIZED (SELECT test, z, count(*) AS n, sum(g) AS sg, sum(g * u) AS sgu, sum(g * g) AS sgg,
          sum(g * g * u) AS sggu, sum(g * g * u2) AS sgguu, sum(y) AS sy, sum(g * y) AS sgy, sum(g * u * y) AS sguy,
          sum(y * y) AS yy FROM obs JOIN u{i + 1} USING (sample) GROUP BY 1, 2),
        s{i} AS (SELECT test, sum(n) AS n, sum(sg) AS sg, sum(sgu) AS sgu, sum(sgg) AS sgg, sum(sggu) AS sggu,
          sum(sgguu) AS sgguu, sum(sy) AS sy, sum(sgy) AS sgy, sum(sguy) AS sguy, sum(yy) AS yy,
          sum({alpha} * sgu) AS pull FROM l{i} {level} GROUP BY 1),
        v{i} AS (SELECT s{i}.*, m0, m1, tau, psi, 1 / (1 + tau * sgguu) AS q,
          tau / (1 + tau * sgguu) * (sguy - sgu * m0 - sggu * m1 - pull) AS v FROM s{i} JOIN t{i}v USING (test)),
        a{i + 1} AS MATERIALIZED (SELECT test, z, 1 / (l.n * tau + psi) AS q,
          tau / (l.n * tau + psi) * (l.sy - l.n * m0 - l.sg * m1 - l.sgu * v) AS alpha FROM l{i} l JOIN v{i} USING (test)),
        e{i} AS (SELECT test, sum({alpha} * n) AS p0, sum({alpha} * sg) AS p1, sum({alpha} * sgu) AS p2,
          sum({alpha} * sy) AS ay, sum(n * (alpha * alpha + q)) AS spread, sum(alpha * alpha + q) AS second,
          count(*) AS seen FROM l{i} JOIN a{i + 1} USING (test, z) GROUP BY 1),
        f{i} AS (SELECT *, (sy - sg * m1 - sgu * v - p0) / n AS k0 FROM v{i} JOIN e{i} USING (test)),
        h{i} AS (SELECT *, tau / (0.01 + tau * sgg) * (sgy - sg * k0 - sggu * v - p1) AS k1 FROM f{i}),
        j{i} AS (SELECT *, yy - 2 * (k0 * sy + k1 * sgy + v * sguy)
          + n * k0 * k0 + sgg * k1 * k1 + sgguu * v * v + 2 * (sg * k0 * k1 + sgu * k0 * v + sggu * k1 * v)
          + n / (tau * n) + sgg / (0.01 + tau * sgg) + sgguu * q
          + {"spread - 2 * (ay - k0 * p0 - k1 * p1 - v * p2)" if grouped else "0"} AS rss,
          second + ((SELECT count(DISTINCT z) FROM u0) - seen) / psi AS whole FROM h{i}),
        t{i + 1}v AS MATERIALIZED (SELECT test, k0 AS m0, k1 AS m1, v AS m2, v * v + q AS q2,
          ({shape} + n / 2.0) / ({shape} + rss / 2) AS tau,
          ({shape} + (SELECT count(DISTINCT z) FROM u0) / 2.0) / ({shape} + whole / 2) AS psi FROM j{i})""")
    return "WITH " + ", ".join(parts)


def vi_steps(fit, digits=4):
    m = X.factors(fit)
    return m.select(
        "test", r("intercept", digits).alias("intercept"), r("f", digits).alias("f"),
        r(F.col("v")[0], digits).alias("v"), r("tau", digits).alias("tau"),
    )


_VI_OUT = f"""SELECT test, {rnd("m0", 4)} AS intercept, {rnd("m1", 4)} AS f, {rnd("m2", 4)} AS v, {rnd("tau", 4)} AS tau"""


@query("eqtl_vi_steps", f"{vi_sql(2, False)} {_VI_OUT} FROM t2v")
def _(t):
    return vi_steps(vi(t, 1, 2, None))


@query("eqtl_vi_grouped_steps", f"{vi_sql(2, True)} {_VI_OUT} FROM t2v")
def _(t):
    return vi_steps(vi(t, 1, 2, None, groups=["donor"]))


@query(
    "eqtl_vi_intercepts",
    f"""{vi_sql(2, True)} SELECT test, 'donor' AS grouping, CAST(z AS VARCHAR) AS level, {rnd("alpha", 4)} AS alpha,
    {rnd("q", 4)} AS variance FROM a2""",
)
def _(t):
    out = X.intercepts(vi(t, 1, 2, None, groups=["donor"]))
    return out.withColumns({c: r(c, 4) for c in ("alpha", "variance")})


@query("eqtl_vi")
def _(t):
    return X.loadings(vi(t, groups=["donor"]))


@query("eqtl_vi_three_steps")
def _(t):
    return X.loadings(vi(t, 3, 3, None, warmup=1, groups=["donor"]))


@query("eqtl_vi_two_groupings")
def _(t):
    return X.factors(vi(t, groups=["donor", "segment"], n_covariates=1))


@query("eqtl_vi_sparse_factors")
def _(t):
    return X.factors(vi(t, factor_spike=True, environment_effect=True, learn_covariates=1))


@query("eqtl_vi_ard_tied")
def _(t):
    return X.factors(vi(t, ard="both", tied_residual=True))


@query("eqtl_vi_binary")
def _(t):
    return X.loadings(vi(t, loading="binary"))


@query("eqtl_vi_dirichlet")
def _(t):
    return X.loadings(vi(t, loading="dirichlet"))


@query("eqtl_vi_stochastic")
def _(t):
    return X.loadings(vi(t, svi_fraction=0.5, groups=["donor"]))


@query("eqtl_vi_zero_inflated")
def _(t):
    return vi(t, zero_inflated=True).obs.groupBy("test").agg(F.avg("w").alias("w"))


@query("eqtl_vi_start_mixed")
def _(t):
    return X.factors(vi(t, groups=["donor"], init="mixed"))


@query("eqtl_vi_start_categories")
def _(t):
    return X.loadings(vi(t, init="categories", init_category="segment"))


@query("eqtl_vi_bound")
def _(t):
    fit = vi(t, groups=["donor"])
    rows = [(i, float(v)) for i, v in enumerate(fit.elbo)]
    return t.spark.createDataFrame(rows, "iteration int, elbo double")


@query("prune_factors")
def _(t):
    return X.loadings(X.prune_factors(vi(t), 0.025))


def given_model(t, obs):
    """Loadings by customer and parameters by brand, made from the tables themselves."""
    u = t.customer.select(
        F.col("c_custkey").alias("sample"),
        F.array((F.col("c_acctbal") / 10_000).cast("double"), F.sin(F.col("c_custkey").cast("double"))).alias("u"),
    )
    b = obs.groupBy("test").agg(
        F.regr_slope("y", "g").alias("f"),
        F.regr_intercept("y", "g").alias("intercept"),
        F.array(F.avg(F.col("y") * F.col("g") * F.col("g")), F.lit(0.25)).alias("v"),
        (F.lit(1.0) / F.var_pop(F.col("y") * F.col("g"))).alias("tau"),
    )
    return u, cut_lineage(b)


_GIVEN = f"""WITH {OBS}, u AS (SELECT c_custkey AS sample, c_acctbal / 10000 AS u0, sin(c_custkey) AS u1 FROM customer),
    b AS MATERIALIZED (SELECT test, regr_slope(y, g) AS f, regr_intercept(y, g) AS base, avg(y * g * g) AS v0, 0.25 AS v1,
      var_pop(y * g) AS s2 FROM obs GROUP BY 1)"""


@query(
    "factor_pve",
    f"""{_GIVEN}, s AS (SELECT sum(g * g * f * f) AS a, sum(g * g * u0 * u0 * v0 * v0) AS b,
      sum(g * g * u1 * u1 * v1 * v1) AS c, sum(s2) AS d FROM obs JOIN u USING (sample) JOIN b USING (test))
    SELECT term, {rnd("x / (a + b + c + d)", 7)} AS pve FROM s, LATERAL
      (VALUES ('shared', a), ('factor_0', b), ('factor_1', c)) AS q(term, x)""",
)
def _(t):
    obs = factor_obs(t)
    u, b = given_model(t, obs)
    return D.factor_pve(obs, u, b).withColumn("pve", r("pve", 7))


@query(
    "loading_pve",
    f"""{_GIVEN}, s AS (SELECT count(*) AS n, sum(u0 * u0) AS a, sum(u1 * u1) AS b FROM u),
    q AS (SELECT sum(v0 * v0) AS c, sum(v1 * v1) AS d, sum(s2) AS e FROM b)
    SELECT factor, {rnd("x / (a * c + b * d + n * e)", 7)} AS pve FROM s, q, LATERAL
      (VALUES (0, a * c), (1, b * d)) AS z(factor, x)""",
)
def _(t):
    u, b = given_model(t, factor_obs(t))
    return D.loading_pve(u, b).withColumn("pve", r("pve", 7))


@query(
    "model_fit",
    f"""{_GIVEN}, e AS (SELECT test, y, g, y - base - g * (f + u0 * v0 + u1 * v1) AS e
      FROM obs JOIN u USING (sample) JOIN b USING (test)),
    s AS (SELECT test, sum(e * e) AS rss, regr_syy(y, g) - regr_sxy(y, g) ** 2 / regr_sxx(y, g) AS rss_null
      FROM e GROUP BY 1)
    SELECT test, {rnd("rss", 4)} AS rss, {rnd("rss_null", 4)} AS rss_null, {rnd("1 - rss / rss_null", 6)} AS r2 FROM s""",
)
def _(t):
    obs = factor_obs(t)
    u, b = given_model(t, obs)
    fit = M.model_fit(obs, u, b)
    return fit.select(
        "test", r("rss", 4).alias("rss"), r("rss_null", 4).alias("rss_null"), r("r2", 6).alias("r2")
    )


def mixture_sql(steps: int) -> str:
    """Steps of the mixture of two regressions, written out."""
    raw = [f"({uniform_sql(f"'{i}', sample")} / 4294967296 + 0.05)" for i in (0, 1)]
    parts = [OBS, f"""p0 AS MATERIALIZED (SELECT sample, {raw[0]} / ({raw[0]} + {raw[1]}) AS p
      FROM (SELECT DISTINCT sample FROM obs))"""]
    for i in range(steps):
        sums, models, logs = [], [], []
        for c, w in ((0, "p"), (1, "(1 - p)")):
            sums.append(", ".join(f"sum({w}{x}) AS {n}{c}" for n, x in (
                ("w", ""), ("g", " * g"), ("y", " * y"), ("gg", " * g * g"), ("gy", " * g * y"), ("yy", " * y * y"))))
            cg, cy = f"(gg{c} - g{c} * g{c} / w{c})", f"(gy{c} - g{c} * y{c} / w{c})"
            b = f"(CASE WHEN {cg} > 1e-12 THEN {cy} / {cg} ELSE 0 END)"
            a = f"((y{c} - {b} * g{c}) / w{c})"
            rss = (f"yy{c} - 2 * {a} * y{c} - 2 * {b} * gy{c} + {a} * {a} * w{c} + 2 * {a} * {b} * g{c}"
                   f" + {b} * {b} * gg{c}")
            models.append(f"{a} AS a{c}, {b} AS b{c}, greatest(({rss}) / w{c}, 1e-8) AS s{c}")
            logs.append(f"sum(-0.5 * ln(2 * pi() * s{c}) - (y - a{c} - b{c} * g) ** 2 / (2 * s{c}))")
        parts.append(f"""q{i} AS (SELECT avg(p) AS a FROM p{i}),
        s{i} AS (SELECT test, {", ".join(sums)} FROM obs JOIN p{i} USING (sample) GROUP BY 1),
        m{i} AS MATERIALIZED (SELECT test, {", ".join(models)} FROM s{i}),
        l{i} AS (SELECT sample, {logs[0]} + ln((SELECT a FROM q{i})) AS x, {logs[1]} + ln(1 - (SELECT a FROM q{i})) AS z
          FROM obs JOIN m{i} USING (test) GROUP BY 1),
        p{i + 1} AS MATERIALIZED (SELECT sample, 1 / (1 + exp(z - x)) AS p FROM l{i})""")
    return "WITH " + ", ".join(parts)


@query("eqtl_mixture")
def _(t):
    return X.eqtl_mixture(factor_obs(t), 2, iterations=200, tolerance=1e-5)[0]


@query("eqtl_mixture_steps", f"{mixture_sql(3)} SELECT sample, {rnd('p', 4)} AS p FROM p3")
def _(t):
    post = X.eqtl_mixture(factor_obs(t), 2, iterations=3)[0]
    return post.select("sample", r(F.col("p")[0], 4).alias("p"))


@query("ase_als")
def _(t):
    return E.ase_als(brand_ase(t), 2, iterations=1, newton_steps=3)[1]


@query("ase_als_fixed_concentration")
def _(t):
    return E.ase_als(brand_ase(t), 1, concentration=10.0, iterations=1, newton_steps=3)[0]


@query("ase_als_folded")
def _(t):
    folded = L.min_allele(brand_ase(t))
    return E.ase_als(folded, 1, family="folded_binomial", iterations=1, newton_steps=3)[1]


@query("ase_em")
def _(t):
    return E.ase_em(brand_ase(t), 1, iterations=1, newton_steps=3)[1]
