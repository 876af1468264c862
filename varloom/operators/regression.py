"""Many small regressions over one long table, one for each test.

Every model is solved from moments summed by Spark (map-side first, so a test that holds a
third of all rows is combined in parallel); numpy only sees one row for each test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.plans.scale import broadcast_if_small, cut_lineage, hash_order, ranked

_DIGITS = 3  # hexadecimal digits of a hash by which the cells of a donor are counted


def group_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, means and population covariances (upper triangle by row) of each group."""
    complete = df.dropna(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return complete.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]).alias("cov"),
    )


def square(flat: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def _solve(sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray):
    """Least squares by pseudo-inverse: coefficients, inverse, residual sum, rank."""
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", sxx), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    r = sxx / safe[:, :, None] / safe[:, None, :]
    inverse = np.linalg.pinv(r, rcond=1e-10, hermitian=True)
    rank = np.linalg.matrix_rank(r, tol=1e-10, hermitian=True) if r.shape[1] else np.zeros(len(r))
    inverse = inverse / safe[:, :, None] / safe[:, None, :]
    beta = np.einsum("bij,bj->bi", inverse, sxy)
    rss = np.maximum(syy - np.einsum("bi,bi->b", beta, sxy), 0.0)
    return beta, inverse, rss, rank


def _log_likelihood(rss: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return -0.5 * n * (np.log(2 * np.pi) + np.log(rss / n) + 1.0)


def grouped_ols(
    df: DataFrame,
    test: Sequence[str],
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
) -> DataFrame:
    """Per test OLS of y on intercept, x and covariates.

    Returns the effect of x with standard error, two-sided t p-value, residual variance,
    log-likelihoods with and without x, and 1 - ll_full / ll_null.
    """
    columns = [x, *covariates, y]
    p = 1 + len(covariates)
    moments = group_moments(df, test, columns)

    def fit(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            n = frame["n"].to_numpy(dtype=float)
            s = square(np.stack(frame["cov"].to_numpy()), p + 1) * n[:, None, None]
            beta, inverse, rss, rank = _solve(s[:, :p, :p], s[:, :p, p], s[:, p, p])
            _, _, null_rss, _ = _solve(s[:, 1:p, 1:p], s[:, 1:p, p], s[:, p, p])
            df_left = n - rank - 1
            out = frame[[*test, "n"]].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                sigma2 = np.where(df_left > 0, rss / df_left, np.nan)
                se = np.sqrt(sigma2 * inverse[:, 0, 0])
                usable = (s[:, 0, 0] > 0) & (inverse[:, 0, 0] > 0)
                out["beta"] = np.where(usable, beta[:, 0], np.nan)
                out["standard_error"] = np.where(usable, se, np.nan)
                t = out["beta"].to_numpy() / out["standard_error"].to_numpy()
                good = np.isfinite(t) & (df_left > 0)
                tail = special.student_t_two_sided(
                    np.where(good, t, 0.0), np.where(good, df_left, 1.0)
                )
                out["pvalue"] = np.where(good, tail, np.nan)
                out["residual_scale"] = sigma2
                out["ll_full"] = _log_likelihood(rss, n)
                out["ll_null"] = _log_likelihood(null_rss, n)
                out["pseudo_r2"] = 1.0 - out["ll_full"] / out["ll_null"]
            yield out

    names = (
        "beta", "standard_error", "pvalue", "residual_scale", "ll_full", "ll_null", "pseudo_r2",
    )
    schema = f"{key_schema(df, test)}, n bigint, " + ", ".join(f"{c} double" for c in names)
    return nan_to_null(moments.mapInPandas(fit, schema), names)


def grouped_ols_residual(
    df: DataFrame,
    test: Sequence[str],
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
) -> DataFrame:
    """Residuals of y and of x on the covariates, then OLS of one on the other without an
    intercept; the effect equals that of ``grouped_ols``, with n - 1 degrees of freedom."""
    columns = [x, *covariates, y]
    p = 1 + len(covariates)
    moments = group_moments(df, test, columns)

    def fit(frames):
        for frame in frames:
            n = frame["n"].to_numpy(dtype=float)
            s = square(np.stack(frame["cov"].to_numpy()), p + 1) * n[:, None, None]
            scc = s[:, 1:p, 1:p]
            bx, _, _, _ = _solve(scc, s[:, 1:p, 0], s[:, 0, 0])
            by, _, syy, _ = _solve(scc, s[:, 1:p, p], s[:, p, p])
            sxx = s[:, 0, 0] - np.einsum("bi,bi->b", bx, s[:, 1:p, 0])
            sxy = s[:, 0, p] - np.einsum("bi,bi->b", bx, s[:, 1:p, p])
            out = frame[[*test, "n"]].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                beta = np.where(sxx > 1e-12 * np.maximum(s[:, 0, 0], 1e-300), sxy / sxx, np.nan)
                rss = np.maximum(syy - beta * sxy, 0.0)
                out["beta"] = beta
                out["standard_error"] = np.sqrt(rss / (n - 1) / sxx)
            yield out

    names = ("beta", "standard_error")
    schema = f"{key_schema(df, test)}, n bigint, beta double, standard_error double"
    return nan_to_null(moments.mapInPandas(fit, schema), names)


def simple_slope(
    df: DataFrame, test: Sequence[str], *, y: str = "y", x: str = "x"
) -> DataFrame:
    """Slope and intercept of y on x for each test."""
    return df.groupBy(*test).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def regress_out(
    df: DataFrame,
    feature: Sequence[str],
    *,
    value: str = "value",
    covariates: Sequence[str] = (),
    pcs: str | None = None,
    n_pcs: int = 0,
    standardize_first: bool = False,
) -> DataFrame:
    """Residual of each feature after OLS on the covariates with an intercept.

    ``pcs`` names an array column whose first ``n_pcs`` entries are covariates too. With
    ``standardize_first`` a feature's values are standardised (population sd) before; a feature
    without spread has NULLs. Collinear covariates are no obstacle.
    """
    names = [f"_pc{i}" for i in range(n_pcs if pcs else 0)]
    rows = df.withColumns({c: F.col(pcs)[i].cast("double") for i, c in enumerate(names)}) if names else df
    if standardize_first:
        moments = rows.groupBy(*feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        scaled = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
        rows = rows.join(moments, list(feature)).withColumn(value, scaled).drop("_m", "_s")
    columns = [*covariates, *names]
    p = len(columns)
    if not p:
        return rows.select(*df.columns)
    moments = group_moments(rows, feature, [*columns, value])

    def fit(frames):
        for frame in frames:
            s = square(np.stack(frame["cov"].to_numpy()), p + 1)
            beta, _, _, _ = _solve(s[:, :p, :p], s[:, :p, p], s[:, p, p])
            mean = np.stack(frame["mean"].to_numpy())
            out = frame[list(feature)].copy()
            out["_a"] = mean[:, p] - np.einsum("bi,bi->b", beta, mean[:, :p])
            out["_b"] = list(beta)
            yield out

    schema = f"{key_schema(df, feature)}, _a double, _b array<double>"
    fits = moments.mapInPandas(fit, schema)
    fitted: Column = F.col("_a")
    for i, c in enumerate(columns):
        fitted = fitted + F.col("_b")[i] * F.col(c)
    out = rows.join(fits, list(feature)).withColumn(value, F.col(value) - fitted)
    return out.select(*df.columns)


def cell_type_effects(
    df: DataFrame,
    test: Sequence[str],
    levels: Sequence,
    *,
    y: str = "y",
    x: str = "x",
    category: str = "cell_type",
) -> DataFrame:
    """Per test OLS of y on x and x within each known cell type.

    The columns are collinear (the type columns add up to x), so the coefficients are those
    of the pseudo-inverse.
    """
    inter = [f"_x{i}" for i in range(len(levels))]
    wide = df.withColumns(
        {c: F.when(F.col(category) == v, F.col(x)).otherwise(0.0) for c, v in zip(inter, levels)}
    )
    columns = [x, *inter, y]
    p = 1 + len(levels)
    moments = group_moments(wide, test, columns)

    def fit(frames):
        for frame in frames:
            s = square(np.stack(frame["cov"].to_numpy()), p + 1)
            mean = np.stack(frame["mean"].to_numpy())
            inverse = np.linalg.pinv(s[:, :p, :p], rcond=1e-10, hermitian=True)
            beta = np.einsum("bij,bj->bi", inverse, s[:, :p, p])
            out = frame[list(test)].copy()
            out["f"] = beta[:, 0]
            out["v"] = list(beta[:, 1:])
            out["intercept"] = mean[:, p] - np.einsum("bi,bi->b", beta, mean[:, :p])
            yield out

    schema = f"{key_schema(df, test)}, f double, v array<double>, intercept double"
    return moments.mapInPandas(fit, schema)


def replicate_samples(
    cells: DataFrame,
    n: int,
    fraction: float,
    seed: int = 0,
    *,
    cell: str = "cell_id",
    individual: str = "individual_id",
) -> DataFrame:
    """For each replicate, ``ceil(n_i * fraction)`` cells of every donor, without replacement.

    The cells with the smallest hashes are taken. They are counted by donor and by the first
    digits of the hash; all below the digits where a donor's number is reached are taken where
    they lie, and only those with these digits are put in order.
    """
    copies = cells.select(cell, individual).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    keyed = copies.withColumn("_h", hash_order(seed, "replicate", cell))
    keyed = keyed.withColumn("_bin", F.substring("_h", 1, _DIGITS))
    by = [individual, "replicate"]
    counts = keyed.groupBy(*by, "_bin").agg(F.count("*").alias("_m"))
    below = Window.partitionBy(*by).orderBy("_bin")
    counts = counts.withColumn("_upto", F.sum("_m").over(below))
    counts = counts.withColumn("_n", F.sum("_m").over(Window.partitionBy(*by)))
    need = F.least(F.ceil(F.col("_n") * F.lit(fraction)), F.col("_n"))
    edge = counts.withColumn("_left", need - F.col("_upto") + F.col("_m")).where((F.col("_left") > 0) & (F.col("_left") <= F.col("_m")))
    edge = edge.select(*by, F.col("_bin").alias("_edge"), "_left")
    placed = keyed.join(broadcast_if_small(cut_lineage(edge), width=4), by)
    last = Window.partitionBy(*by).orderBy("_h", cell)
    some = placed.where("_bin = _edge").withColumn("_rank", F.row_number().over(last)).where("_rank <= _left")
    names = ["replicate", cell, individual]
    return placed.where("_bin < _edge").select(*names).unionByName(some.select(*names))


def bootstrap_stability(
    df: DataFrame,
    cells: DataFrame,
    test: Sequence[str],
    n: int,
    fraction: float,
    seed: int = 0,
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
    residualize: bool = False,
    cell: str = "cell_id",
    individual: str = "individual_id",
    fit: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Effect of every test in every replicate.

    ``residualize`` first removes the covariates from y and x over all cells. ``fit`` may be
    another grouped model that returns ``beta`` (a mixed model, say).
    """
    rows = df
    if residualize and covariates:
        rows = regress_out(rows, test, value=y, covariates=covariates)
        rows = regress_out(rows, test, value=x, covariates=covariates)
    chosen = cut_lineage(
        replicate_samples(cells, n, fraction, seed, cell=cell, individual=individual)
    )
    drawn = rows.drop(individual).join(chosen, cell)
    keys = [*test, "replicate"]
    if fit is not None:
        return fit(drawn, keys).select(*keys, "beta")
    if covariates and not residualize:
        return grouped_ols(drawn, keys, y=y, x=x, covariates=covariates).select(*keys, "beta")
    return drawn.groupBy(*keys).agg(F.regr_slope(y, x).alias("beta"))


def bootstrap_variance(betas: DataFrame, test: Sequence[str]) -> DataFrame:
    """Variance and range of the replicate effects of each test."""
    return betas.groupBy(*test).agg(
        F.var_pop("beta").alias("beta_variance"),
        F.avg("beta").alias("beta_mean"),
        F.count("beta").alias("n_replicates"),
    )


def permute_by_group(
    genotype: DataFrame,
    seed: int = 0,
    *,
    individual: str = "individual_id",
    dosage: str = "dosage",
) -> DataFrame:
    """Permute genotypes between donors: every donor takes all genotypes of another one, so
    the cells of a donor move together."""
    donors = genotype.select(individual).distinct()
    place = ranked(donors, [individual], out="_place")
    shuffled = ranked(
        donors.withColumn("_h", hash_order(seed, individual)), ["_h", individual], out="_place"
    ).select(F.col(individual).alias("_source"), "_place")
    swap = place.join(shuffled, "_place").select(individual, "_source")
    given = genotype.withColumnRenamed(individual, "_source")
    return given.join(swap, "_source").drop("_source").select(*genotype.columns)


def model_fit(
    df: DataFrame,
    samples: DataFrame,
    tests: DataFrame,
    *,
    test: str = "test",
    sample: str = "sample",
    y: str = "y",
    g: str = "g",
) -> DataFrame:
    """Per test residual sum of squares of the factor model and its R squared against the
    model with genotype only.

    ``samples`` has the loading array ``u``; ``tests`` has ``v``, ``f`` and ``intercept``.
    """
    dot = F.aggregate(
        F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    joined = df.join(samples.select(sample, "u"), sample).join(
        tests.select(test, "v", "f", "intercept"), test
    )
    error = F.col(y) - F.col("intercept") - F.col(g) * (F.col("f") + dot)
    return joined.groupBy(test).agg(
        F.sum(error * error).alias("rss"),
        (F.regr_syy(y, g) - F.regr_sxy(y, g) * F.regr_sxy(y, g) / F.regr_sxx(y, g)).alias("rss_null"),
    ).withColumn("r2", 1 - F.col("rss") / F.col("rss_null"))
