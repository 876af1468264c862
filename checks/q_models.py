"""Neighbours and per-test models on the driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.q_basic import r, rnd
from checks.q_joins import stand_pairs
from checks.registry import query, solved_sql, t_two_sided
from checks.standins import with_ctes
from varloom.operators import aggregates as A
from varloom.operators import mixed as X
from varloom.operators import neighbors as K
from varloom.operators import regression as M

# ------------------------------------------------------------- neighbours


def vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("cell_id"), F.col("label").alias("individual_id"),
        F.col("embedding").alias("pcs"),
    )


_RAW = """e AS (SELECT vec_id AS cell_id, label AS individual_id,
    CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_STD = """l AS (SELECT vec_id, label, unnest(range(64)) AS d,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    z AS (SELECT vec_id, label, d, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM l
      WINDOW w AS (PARTITION BY d)),
    e AS (SELECT vec_id AS cell_id, label AS individual_id, list(z ORDER BY d) AS v
      FROM z GROUP BY 1, 2)"""


def _knn_sql(source: str, k: int, distance: str = "list_distance(a.v, b.v)") -> str:
    return f"""WITH {source}, p AS (SELECT a.individual_id, a.cell_id, b.cell_id AS neighbor_id,
      {distance} AS distance FROM e a JOIN e b ON a.individual_id = b.individual_id
      AND a.cell_id <> b.cell_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbor_id) AS rank
      FROM p QUALIFY rank <= {k})"""


@query(
    "knn",
    f"""{_knn_sql(_STD, 10)} SELECT individual_id, cell_id, neighbor_id, CAST(rank AS INTEGER) AS rank,
    {rnd("distance", 5)} AS distance FROM k""",
)
def _(t):
    return K.knn(vectors(t), 10, block_size=64).withColumn("distance", r("distance", 5))


@query(
    "knn_pearson",
    f"""{_knn_sql(_RAW, 5, '''sqrt(greatest(0, 2 - 2 * list_inner_product(
        list_transform(a.v, lambda x: x - list_avg(a.v)), list_transform(b.v, lambda x: x - list_avg(b.v)))
        / sqrt(list_inner_product(list_transform(a.v, lambda x: x - list_avg(a.v)),
             list_transform(a.v, lambda x: x - list_avg(a.v))))
        / sqrt(list_inner_product(list_transform(b.v, lambda x: x - list_avg(b.v)),
             list_transform(b.v, lambda x: x - list_avg(b.v))))))''')}
    SELECT individual_id, cell_id, neighbor_id, CAST(rank AS INTEGER) AS rank,
    {rnd("distance", 5)} AS distance FROM k""",
)
def _(t):
    e = K.knn(vectors(t), 5, metric="pearson", block_size=64)
    return e.withColumn("distance", r("distance", 5))


@query(
    "knn_weighted_adaptive",
    f"""{_knn_sql(_STD, 9)}, w AS (SELECT cell_id, distance AS width FROM k WHERE rank = 3)
    SELECT cell_id, neighbor_id, {rnd("width", 5)} AS width,
    {rnd("exp(-(distance / width) * (distance / width))", 5)} AS weight FROM k JOIN w USING (cell_id)""",
)
def _(t):
    e = K.knn_weighted(vectors(t), 3, block_size=64)
    return e.select(
        "cell_id", "neighbor_id", r("width", 5).alias("width"), r("weight", 5).alias("weight")
    )


@query(
    "knn_weighted_median",
    f"""{_knn_sql(_STD, 9)}, w AS (SELECT median(distance) AS width FROM k WHERE rank = 3)
    SELECT cell_id, neighbor_id, {rnd("width", 5)} AS width,
    {rnd("exp(-(distance / width) * (distance / width))", 5)} AS weight FROM k, w""",
)
def _(t):
    e = K.knn_weighted(vectors(t), 3, width="median", block_size=64)
    return e.select(
        "cell_id", "neighbor_id", r("width", 5).alias("width"), r("weight", 5).alias("weight")
    )


_EDGES = """edges AS (SELECT c1.cell_id, c2.cell_id AS neighbor_id, 1.0 / (1 + abs(c1.day - c2.day))
    AS weight FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY cell_id) AS k
      FROM cells) c1 JOIN (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY cell_id) AS k
      FROM cells) c2 ON c1.donor_id = c2.donor_id AND abs(c1.k - c2.k) BETWEEN 1 AND 2)"""


def edges(t):
    """Each order with the two orders of the customer before and after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("donor_id").orderBy("cell_id")
    c = S.cells(t).select("cell_id", "donor_id", "day").withColumn("k", F.row_number().over(w))
    other = c.select(
        "donor_id", F.col("cell_id").alias("neighbor_id"), F.col("day").alias("day2"), F.col("k").alias("k2")
    )
    near = c.withColumn("k2", F.explode(F.array(*[F.col("k") + i for i in (-2, -1, 1, 2)])))
    return near.join(other, ["donor_id", "k2"]).select(
        "cell_id", "neighbor_id", (1.0 / (1 + F.abs(F.col("day") - F.col("day2")))).alias("weight")
    )


@query(
    "knn_boost",
    f"""{with_ctes("cells", "counts")}, {_EDGES}, l AS (SELECT cell_id, neighbor_id FROM edges
      UNION ALL SELECT DISTINCT cell_id, cell_id FROM counts)
    SELECT l.cell_id, gene_id, sum(count) AS count FROM l JOIN counts c
    ON c.cell_id = l.neighbor_id GROUP BY 1, 2""",
)
def _(t):
    return K.knn_boost(S.counts(t), edges(t))


@query(
    "knn_boost_weighted",
    f"""{with_ctes("cells", "counts")}, {_EDGES}, l AS (SELECT cell_id, neighbor_id, weight FROM edges
      UNION ALL SELECT DISTINCT cell_id, cell_id, 1.0 FROM counts),
    n AS (SELECT cell_id, sum(weight) AS n FROM l GROUP BY 1)
    SELECT l.cell_id, gene_id, {rnd("sum(count * weight / n)", 5)} AS count FROM l JOIN n USING (cell_id)
    JOIN counts c ON c.cell_id = l.neighbor_id GROUP BY 1, 2""",
)
def _(t):
    b = K.knn_boost(S.counts(t), edges(t), weighted=True)
    return b.withColumn("count", r("count", 5))


@query(
    "knn_category_summary",
    f"""{with_ctes("cells")}, {_EDGES}, p AS (SELECT a.cell_type AS category,
      b.cell_type AS neighbor_category, count(*) AS n FROM edges e JOIN cells a USING (cell_id)
      JOIN cells b ON b.cell_id = e.neighbor_id GROUP BY 1, 2)
    SELECT category, neighbor_category,
    {rnd("n / sum(n) OVER (PARTITION BY category)")} AS fraction FROM p""",
)
def _(t):
    s = A.knn_category_summary(edges(t), S.cells(t), "cell_type")
    return s.withColumn("fraction", r("fraction"))


@query(
    "knn_category_summary_weighted",
    f"""{with_ctes("cells")}, {_EDGES}, n AS (SELECT *, weight / sum(weight) OVER
      (PARTITION BY cell_id) AS w FROM edges), p AS (SELECT a.batch AS category,
      b.batch AS neighbor_category, sum(w) AS n FROM n e JOIN cells a USING (cell_id)
      JOIN cells b ON b.cell_id = e.neighbor_id GROUP BY 1, 2)
    SELECT category, neighbor_category,
    {rnd("n / sum(n) OVER (PARTITION BY category)")} AS fraction FROM p""",
)
def _(t):
    s = A.knn_category_summary(edges(t), S.cells(t), "batch", weighted=True)
    return s.withColumn("fraction", r("fraction"))


# ------------------------------------------------------------ regressions

_EQTL = f"""{with_ctes("cells", "counts", "genes", "genotype")},
    v AS (SELECT DISTINCT variant_id, chrom, pos FROM genotype),
    p AS (SELECT gene_id, variant_id FROM genes g JOIN v ON g.chrom = v.chrom
      AND abs(pos - start_pos) <= 30000),
    e AS (SELECT individual_id, gene_id, ln(1 + sum(count)) AS y FROM counts
      JOIN cells USING (cell_id) GROUP BY 1, 2),
    c AS (SELECT individual_id, avg(pseudotime) / 1000 AS age FROM cells GROUP BY 1),
    d AS (SELECT gene_id, variant_id, individual_id, y, dosage AS x, age FROM p
      JOIN e USING (gene_id) JOIN genotype USING (variant_id, individual_id)
      JOIN c USING (individual_id) WHERE dosage IS NOT NULL)"""


def eqtl_rows(t, distance=30_000):
    """One row for each test and donor: pseudobulk expression, dosage and a covariate."""
    e = A.pseudobulk(S.counts(t), S.cells(t), ["individual_id"])
    e = e.select("individual_id", "gene_id", F.log1p("count").alias("y"))
    g = S.genotype(t).where(F.col("dosage").isNotNull())
    g = g.select("variant_id", "individual_id", F.col("dosage").alias("x"))
    c = S.cells(t).groupBy("individual_id").agg((F.avg("pseudotime") / 1000).alias("age"))
    pairs = stand_pairs(t, distance).select("gene_id", "variant_id")
    return (
        pairs.join(e, "gene_id")
        .join(g, ["variant_id", "individual_id"])
        .join(c, "individual_id")
        .select("gene_id", "variant_id", "individual_id", "y", "x", "age")
    )


TEST = ["gene_id", "variant_id"]


@query(
    "grouped_ols",
    f"""{_EQTL}, s AS (SELECT gene_id, variant_id, count(*) AS n, regr_slope(y, x) AS b,
      regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY 1, 2),
    f AS (SELECT *, (syy - sxy * sxy / sxx) AS rss FROM s WHERE sxx > 0 AND n > 2)
    SELECT gene_id, variant_id, n, {rnd("b", 5)} AS beta,
    {rnd("sqrt(rss / (n - 2) / sxx)", 5)} AS standard_error,
    {rnd(t_two_sided("b / sqrt(rss / (n - 2) / sxx)", "n - 2"), 5)} AS pvalue,
    {rnd("rss / (n - 2)", 4)} AS residual_scale,
    {rnd("1 - (ln(2 * pi() * rss / n) + 1) / (ln(2 * pi() * syy / n) + 1)", 5)} AS pseudo_r2 FROM f""",
)
def _(t):
    f = M.grouped_ols(eqtl_rows(t), TEST).where("standard_error IS NOT NULL")
    return f.select(
        *TEST, "n", r("beta", 5).alias("beta"), r("standard_error", 5).alias("standard_error"),
        r("pvalue", 5).alias("pvalue"), r("residual_scale", 4).alias("residual_scale"),
        r("pseudo_r2", 5).alias("pseudo_r2"),
    )


_TWO = f"""{_EQTL}, s AS (SELECT gene_id, variant_id, count(*) AS n, var_pop(x) AS xx,
      var_pop(age) AS cc, covar_pop(x, age) AS xc, covar_pop(y, x) AS xy, covar_pop(y, age) AS cy,
      var_pop(y) AS yy FROM d GROUP BY 1, 2),
    f AS (SELECT *, (xy - xc * cy / cc) / (xx - xc * xc / cc) AS b, xx - xc * xc / cc AS rx
      FROM s WHERE xx > 0 AND n > 4 AND xx - xc * xc / cc > 1e-9 * xx),
    o AS (SELECT *, n * (yy - cy * cy / cc - b * (xy - xc * cy / cc)) AS rss FROM f)"""


@query(
    "grouped_ols_covariate",
    f"""{_TWO} SELECT gene_id, variant_id, {rnd("b", 5)} AS beta,
    {rnd("sqrt(rss / (n - 3) / (n * rx))", 5)} AS standard_error FROM o""",
)
def _(t):
    f = M.grouped_ols(eqtl_rows(t), TEST, covariates=["age"])
    f = f.where("standard_error IS NOT NULL AND n > 4")
    return f.select(
        *TEST, r("beta", 5).alias("beta"), r("standard_error", 5).alias("standard_error")
    )


@query(
    "grouped_ols_residual",
    f"""{_TWO} SELECT gene_id, variant_id, {rnd("b", 5)} AS beta,
    {rnd("sqrt(rss / (n - 1) / (n * rx))", 5)} AS standard_error FROM o""",
)
def _(t):
    f = M.grouped_ols_residual(eqtl_rows(t), TEST, covariates=["age"])
    f = f.where("standard_error IS NOT NULL AND n > 4")
    return f.select(
        *TEST, r("beta", 5).alias("beta"), r("standard_error", 5).alias("standard_error")
    )


@query(
    "simple_slope",
    f"""{_EQTL} SELECT gene_id, variant_id, {rnd("regr_slope(y, x)", 5)} AS slope,
    {rnd("regr_intercept(y, x)", 5)} AS intercept FROM d GROUP BY 1, 2 HAVING var_pop(x) > 0""",
)
def _(t):
    f = M.simple_slope(eqtl_rows(t), TEST).where("slope IS NOT NULL")
    return f.select(*TEST, r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"))


@query(
    "regress_out",
    f"""{with_ctes("counts", "cells")}, x AS (SELECT cell_id, gene_id, count AS y,
      pseudotime / 1000 AS c FROM counts JOIN cells USING (cell_id)),
    b AS (SELECT gene_id, regr_slope(y, c) AS b, regr_intercept(y, c) AS a FROM x GROUP BY 1)
    SELECT cell_id, gene_id, {rnd("y - a - b * c", 5)} AS value FROM x JOIN b USING (gene_id)""",
)
def _(t):
    x = S.counts(t).join(S.cells(t), "cell_id").select(
        "cell_id", "gene_id", F.col("count").alias("value"), (F.col("pseudotime") / 1000).alias("c")
    )
    out = M.regress_out(x, ["gene_id"], covariates=["c"])
    return out.select("cell_id", "gene_id", r("value", 5).alias("value"))


_PCS = f"""{with_ctes("counts", "cells")}, z AS (SELECT cell_id, gene_id, pseudotime / 1e5 AS c, sin(cell_id) AS d,
      (count - avg(count) OVER w) / stddev_pop(count) OVER w AS y FROM counts JOIN cells USING (cell_id)
      WINDOW w AS (PARTITION BY gene_id)),
    m AS (SELECT gene_id, avg(c) AS mc, avg(d) AS md, var_pop(c) AS cc, var_pop(d) AS dd, covar_pop(c, d) AS cd,
      covar_pop(c, y) AS cy, covar_pop(d, y) AS dy FROM z GROUP BY 1)"""


@query(
    "regress_out_pcs",
    f"""{_PCS}, b AS (SELECT *, {solved_sql([["cc", "cd"], ["cd", "dd"]], ["cy", "dy"])[0]} AS b0,
      {solved_sql([["cc", "cd"], ["cd", "dd"]], ["cy", "dy"])[1]} AS b1 FROM m)
    SELECT cell_id, gene_id, {rnd("y - b0 * (c - mc) - b1 * (d - md)", 5)} AS value FROM z JOIN b USING (gene_id)""",
)
def _(t):
    pcs = F.array((F.col("pseudotime") / 1e5).cast("double"), F.sin(F.col("cell_id").cast("double")), F.lit(7.0))
    x = S.counts(t).join(S.cells(t), "cell_id").select(
        "cell_id", "gene_id", F.col("count").alias("value"), pcs.alias("pcs")
    )
    out = M.regress_out(x, ["gene_id"], pcs="pcs", n_pcs=2, standardize_first=True)
    return out.select("cell_id", "gene_id", r("value", 5).alias("value"))


def _effects_sql() -> str:
    """Slopes within the three known types, then their smallest solution: f is a quarter of their
    sum, since f + v[i] is the slope of type i."""
    x = [f"(CASE WHEN l_returnflag = '{c}' THEN l_discount ELSE 0 END)" for c in "ANR"]
    cells = [f"covar_pop({x[i]}, {x[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)]
    right = [f"covar_pop(l_extendedprice, {x[i]}) AS d{i}, avg({x[i]}) AS x{i}" for i in range(3)]
    a = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    slopes = solved_sql(a, ["d0", "d1", "d2"])
    return f"""WITH m AS (SELECT p_brand, avg(l_extendedprice) AS y, {", ".join(cells + right)}
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
      s AS (SELECT *, {slopes[0]} AS s0, {slopes[1]} AS s1, {slopes[2]} AS s2 FROM m)
      SELECT p_brand, {rnd("(s0 + s1 + s2) / 4", 2)} AS f, {rnd("s0 - (s0 + s1 + s2) / 4", 2)} AS v_a,
      {rnd("s1 - (s0 + s1 + s2) / 4", 2)} AS v_n, {rnd("s2 - (s0 + s1 + s2) / 4", 2)} AS v_r,
      {rnd("y - s0 * x0 - s1 * x1 - s2 * x2", 3)} AS intercept FROM s"""


@query("cell_type_effects", _effects_sql())
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    f = M.cell_type_effects(
        rows, ["p_brand"], ["A", "N", "R"], y="l_extendedprice", x="l_discount", category="l_returnflag"
    )
    v = F.col("v")
    return f.select(
        "p_brand", r("f", 2).alias("f"), r(v[0], 2).alias("v_a"), r(v[1], 2).alias("v_n"),
        r(v[2], 2).alias("v_r"), r("intercept", 3).alias("intercept"),
    )


@query(
    "bootstrap_stability",
    f"""{with_ctes("cells")}, reps AS (SELECT cell_id, individual_id, CAST(r AS INTEGER) AS replicate
      FROM cells, range(5) AS q(r)),
    k AS (SELECT *, row_number() OVER (PARTITION BY individual_id, replicate
      ORDER BY md5(concat_ws('|', '11', replicate, cell_id)), cell_id) AS k,
      count(*) OVER (PARTITION BY individual_id, replicate) AS n FROM reps),
    s AS (SELECT replicate, cell_id FROM k WHERE k <= ceil(n * 0.5))
    SELECT p_brand AS gene_id, replicate, {rnd("regr_slope(l_extendedprice, l_discount)", 2)} AS beta
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON l_orderkey = cell_id GROUP BY 1, 2""",
)
def _(t):
    b = M.bootstrap_stability(
        gene_rows(t), S.cells(t), ["gene_id"], 5, 0.5, 11, y="price", x="x"
    )
    return b.withColumn("beta", r("beta", 2))


def gene_rows(t):
    """Line items as cell-level rows of a per-brand model."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("gene_id"),
        F.col("l_orderkey").alias("cell_id"),
        F.col("l_suppkey").alias("individual_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") / 10_000).alias("y"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("x"),
        F.col("l_tax").alias("tax"),
        F.concat("l_returnflag", "l_linestatus").alias("plate_id"),
        (F.col("p_size") / 50).alias("pseudotime"),
    )


@query(
    "bootstrap_variance",
    f"""{with_ctes("cells")}, reps AS (SELECT cell_id, individual_id, CAST(r AS INTEGER) AS replicate
      FROM cells, range(4) AS q(r)),
    k AS (SELECT *, row_number() OVER (PARTITION BY individual_id, replicate
      ORDER BY md5(concat_ws('|', '2', replicate, cell_id)), cell_id) AS k,
      count(*) OVER (PARTITION BY individual_id, replicate) AS n FROM reps),
    s AS (SELECT replicate, cell_id FROM k WHERE k <= ceil(n * 0.8)),
    b AS (SELECT p_brand AS gene_id, replicate, regr_slope(l_extendedprice / 10000, l_discount) AS b
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON l_orderkey = cell_id GROUP BY 1, 2)
    SELECT gene_id, {rnd("var_pop(b)", 5)} AS beta_variance, {rnd("avg(b)", 5)} AS beta_mean,
    count(b) AS n_replicates FROM b GROUP BY 1""",
)
def _(t):
    b = M.bootstrap_stability(gene_rows(t), S.cells(t), ["gene_id"], 4, 0.8, 2)
    v = M.bootstrap_variance(b, ["gene_id"])
    return v.withColumns({c: r(c, 5) for c in ("beta_variance", "beta_mean")})


@query(
    "permute_by_group",
    f"""{with_ctes("genotype")}, d AS (SELECT DISTINCT individual_id FROM genotype),
    a AS (SELECT individual_id, row_number() OVER (ORDER BY individual_id) AS k FROM d),
    b AS (SELECT individual_id AS source, row_number() OVER
      (ORDER BY md5(concat_ws('|', '4', individual_id)), individual_id) AS k FROM d)
    SELECT variant_id, chrom, pos, a.individual_id, dosage FROM a JOIN b USING (k)
    JOIN genotype g ON g.individual_id = source""",
)
def _(t):
    return M.permute_by_group(S.genotype(t), 4)


def _det(m) -> str:
    if len(m) == 1:
        return f"({m[0][0]})"
    parts = []
    for j in range(len(m)):
        rest = [row[:j] + row[j + 1 :] for row in m[1:]]
        parts.append(f"{'-' if j % 2 else '+'} {m[0][j]} * {_det(rest)}")
    return "(" + " ".join(parts) + ")"


_MIXED = """d AS (SELECT p_brand AS gene_id, l_suppkey AS z, l_discount AS x, l_tax AS c, l_extendedprice / 10000 AS y
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    lv AS MATERIALIZED (SELECT gene_id, z, count(*)::DOUBLE AS a, sum(x) AS x, sum(c) AS c, sum(y) AS y FROM d GROUP BY 1, 2),
    tot AS MATERIALIZED (SELECT gene_id, count(*)::DOUBLE AS aa, sum(x) AS ax, sum(c) AS ac, sum(y) AS ay, sum(x * x) AS xx,
      sum(x * c) AS xc, sum(x * y) AS xy, sum(c * c) AS cc, sum(c * y) AS cy, sum(y * y) AS yy FROM d GROUP BY 1)"""


def mixed_sql(name: str, fixed: str, reml: bool, steps: int = 60) -> str:
    """The variance ratio of least deviance by thirds of an interval, and what follows from it.

    ``fixed`` names columns: a for the intercept, x, c; y is the outcome. The result ``name`` has
    theta, dev, sigma2 and, with x among the columns, beta and its variance factor inv.
    """
    order = "axcy"
    pairs = [a + b for i, a in enumerate(order) for b in order[i:]]

    def entry(a, b):
        return "w" + "".join(sorted(a + b, key=order.index))

    def square(columns):
        return [[entry(a, b) for b in columns] for a in columns]

    left = f"(waa0 - {len(fixed)})" if reml else "waa0"
    rss = f"({_det(square(fixed + 'y'))} / {_det(square(fixed))})"
    dev = f"{left} * (ln(2 * pi() * {rss} / {left}) + 1) + ld"
    dev += f" + ln({_det(square(fixed))})" if reml else ""
    sums = ", ".join(f"any_value(tot.{q}) - sum(th / (1 + lv.a * th) * lv.{q[0]} * lv.{q[1]}) AS w{q}" for q in pairs)

    def values(points: str, out: str, extra: str = "") -> str:
        return f"""{out}w AS (SELECT gene_id, th, {sums}, any_value(tot.aa) AS waa0, sum(ln(1 + lv.a * th)) AS ld
          FROM lv JOIN tot USING (gene_id) JOIN {points} USING (gene_id) GROUP BY gene_id, th),
        {out} AS MATERIALIZED (SELECT gene_id, th, {dev} AS dev{extra} FROM {out}w)"""

    parts = [f"{name}t0 AS (SELECT gene_id, 0.0::DOUBLE AS lo, 0.999::DOUBLE AS hi FROM tot)"]
    for k in range(steps):
        p, q = "(lo + (hi - lo) / 3)", "(hi - (hi - lo) / 3)"
        parts.append(f"""{name}p{k} AS (SELECT gene_id, unnest([{p} / (1 - {p}), {q} / (1 - {q})]) AS th FROM {name}t{k}),
        {values(f"{name}p{k}", f"{name}v{k}")},
        {name}t{k + 1} AS MATERIALIZED (SELECT gene_id, CASE WHEN arg_min(th, dev) = max(th) THEN any_value({p}) ELSE any_value(lo) END AS lo,
          CASE WHEN arg_min(th, dev) = max(th) THEN any_value(hi) ELSE any_value({q}) END AS hi
          FROM {name}v{k} JOIN {name}t{k} USING (gene_id) GROUP BY gene_id)""")
    extra = f", {rss} / {left} AS sigma2"
    if "x" in fixed:
        at = fixed.index("x")
        swapped = [[entry(r, "y") if j == at else entry(r, f) for j, f in enumerate(fixed)] for r in fixed]
        minor = [[entry(a, b) for b in fixed if b != "x"] for a in fixed if a != "x"]
        extra += f", {_det(swapped)} / {_det(square(fixed))} AS beta, {_det(minor)} / {_det(square(fixed))} AS inv"
    mid = "((lo + hi) / 2)"
    parts.append(f"{name}pe AS (SELECT gene_id, unnest([0.0, {mid} / (1 - {mid})]) AS th FROM {name}t{steps})")
    parts.append(values(f"{name}pe", f"{name}ve", extra))
    parts.append(f"{name} AS (SELECT * FROM {name}ve QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY dev, th) = 1)")
    return ", ".join(parts)


@query(
    "grouped_lmm_estimates",
    f"""WITH {_MIXED}, {mixed_sql("r", "axc", True)}
    SELECT gene_id, {rnd("beta", 4)} AS beta, {rnd("sqrt(sigma2 * inv)", 4)} AS standard_error,
    {rnd("sqrt(th * sigma2)", 3)} AS re_sd, {rnd("sqrt(sigma2)", 4)} AS residual_sd FROM r""",
)
def _(t):
    f = X.grouped_lmm(gene_rows(t), ["gene_id"], covariates=["tax"])
    digits = {"beta": 4, "standard_error": 4, "re_sd": 3, "residual_sd": 4}
    return f.select("gene_id", *[r(c, d).alias(c) for c, d in digits.items()])


@query(
    "eqtl_lrt_one_grouping",
    f"""WITH {_MIXED}, {mixed_sql("f", "acx", False)}, {mixed_sql("n", "ac", False)}
    SELECT gene_id, {rnd("greatest(n.dev - f.dev, 0)", 4)} AS lr, {rnd("f.beta", 4)} AS effect FROM f JOIN n USING (gene_id)""",
)
def _(t):
    f = X.eqtl_lrt(gene_rows(t), ["gene_id"], covariates=["tax"], groups=["individual_id"])
    return f.select("gene_id", r("lr", 4).alias("lr"), r(F.col("effects")[0], 4).alias("effect"))


@query("grouped_lmm")
def _(t):
    return X.grouped_lmm(gene_rows(t), ["gene_id"], covariates=["tax"])


@query("eqtl_lrt")
def _(t):
    return X.eqtl_lrt(
        gene_rows(t), ["gene_id"], covariates=["tax"], groups=["individual_id", "plate_id"]
    )


@query("dynamic_lrt")
def _(t):
    return X.dynamic_lrt(
        gene_rows(t), ["gene_id"], covariates=["tax"], groups=["individual_id", "plate_id"]
    )


@query("dynamic_quadratic_lrt")
def _(t):
    return X.dynamic_lrt(
        gene_rows(t), ["gene_id"], covariates=["tax"], groups=["individual_id"], quadratic=True
    )


@query("modulated_lrt")
def _(t):
    rows = gene_rows(t).drop("individual_id").join(
        S.cells(t).select("cell_id", "individual_id"), "cell_id"
    )
    return X.modulated_lrt(rows, ["gene_id"], covariates=["tax", "pseudotime"])


@query("het_test")
def _(t):
    return X.het_test(gene_rows(t), ["gene_id"], covariates=["tax"])
