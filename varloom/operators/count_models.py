"""Per-key count models: negative-binomial regression and allelic-fraction estimates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.operators.regression import key_schema, nan_to_null
from varloom.plans.newton import newton_by_key
from varloom.plans.scale import cut_lineage

# fixed values: gamma prior of the concentration
CONC_SHAPE, CONC_RATE = 1.0001, 1e-4


def _outer(weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    return weight[:, None, None] * x[:, :, None] * x[:, None, :]


def negbin_terms(frame, theta):
    """Row terms of a log-link negative binomial; the last parameter is the log dispersion."""
    x = np.stack(frame["_x"].to_numpy()).astype(float)
    y = frame["_y"].to_numpy(dtype=float)
    eta = np.clip(np.einsum("bi,bi->b", x, theta[:, :-1]) + frame["_offset"].to_numpy(), -40, 40)
    mu = np.exp(eta)
    r = np.exp(-np.clip(theta[:, -1], -18, 12))
    total = r + mu
    ll = (
        special.gammaln(y + r) - special.gammaln(r) - special.gammaln(y + 1.0)
        - r * np.log1p(mu / r) + y * (eta - np.log(total))
    )
    d_eta = (y - mu) * r / total
    h_eta = -mu * r * (y + r) / total**2
    d_r = special.digamma(y + r) - special.digamma(r) - np.log1p(mu / r) + (mu - y) / total
    h_r = (
        special.trigamma(y + r) - special.trigamma(r) + mu / (r * total) + (y - mu) / total**2
    )
    cross = -r * (y - mu) * mu / total**2
    p = theta.shape[1]
    grad = np.column_stack([d_eta[:, None] * x, -r * d_r])
    hess = np.zeros((len(y), p, p))
    hess[:, :-1, :-1] = _outer(h_eta, x)
    hess[:, :-1, -1] = hess[:, -1, :-1] = cross[:, None] * x
    hess[:, -1, -1] = r * r * h_r + r * d_r
    return ll, grad, hess


def _negbin(rows: DataFrame, test: Sequence[str], columns: Sequence[str], y: str, exposure: str) -> DataFrame:
    p = len(columns) + 1
    ready = rows.select(
        *test,
        F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("_x"),
        F.col(y).cast("double").alias("_y"),
        F.log(F.col(exposure).cast("double")).alias("_offset"),
    )
    rate = F.log(F.sum(y) / F.sum(exposure))
    zeros = [F.lit(0.0)] * len(columns)
    start = rows.groupBy(*test).agg(F.array(rate, *zeros, F.lit(-0.5)).alias("theta"))
    return newton_by_key(
        ready, start.where(F.col("theta")[0].isNotNull()), test, p + 1, negbin_terms, tol=1e-12
    )


def grouped_negbin(
    df: DataFrame,
    test: Sequence[str],
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
    exposure: str = "library_size",
) -> DataFrame:
    """Per test negative-binomial regression of counts on x and covariates with an exposure:
    effect, standard error, normal p-value and 1 - ll_full / ll_null. Tests whose fit fails
    have NULL statistics."""
    columns = [x, *covariates]
    rows = df.dropna(subset=[*columns, y, exposure]).where(F.col(exposure) > 0)
    rows = cut_lineage(rows.select(*test, *columns, y, exposure))  # read in every pass
    full = _negbin(rows, test, columns, y, exposure)
    null = _negbin(rows, test, list(covariates), y, exposure)
    p = len(columns) + 2

    def summarise(frames):
        for frame in frames:
            theta = np.stack(frame["theta"].to_numpy()).astype(float)
            hess = np.stack(frame["hessian"].to_numpy()).astype(float).reshape(-1, p, p)
            out = frame[[*test, "ll", "null_ll"]].copy()
            var = np.full(len(frame), np.nan)
            for i, h in enumerate(hess):
                try:
                    var[i] = np.linalg.inv(-h)[1, 1]
                except np.linalg.LinAlgError:
                    pass
            good = frame["converged"].to_numpy(dtype=bool) & (var > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                se = np.where(good, np.sqrt(var), np.nan)
                beta = np.where(good, theta[:, 1], np.nan)
                z = np.where(good, beta / se, 0.0)
            out["beta"], out["standard_error"] = beta, se
            out["pvalue"] = np.where(good, special.normal_two_sided(z), np.nan)
            out["pseudo_r2"] = np.where(good, 1 - out["ll"] / out["null_ll"], np.nan)
            out["dispersion"] = np.where(good, np.exp(theta[:, -1]), np.nan)
            yield out

    names = ("beta", "standard_error", "pvalue", "pseudo_r2", "dispersion")
    schema = f"{key_schema(df, test)}, ll double, null_ll double, " + ", ".join(
        f"{c} double" for c in names
    )
    both = full.join(null.select(*test, F.col("ll").alias("null_ll")), list(test))
    return nan_to_null(both.mapInPandas(summarise, schema), names)


def beta_binomial_parts(y, n, eta, log_conc):
    """Log probability with its derivatives in the logit mean and the log concentration:
    value, (d_eta, d_lambda), (h_eta, h_cross, h_lambda)."""
    p = special.sigmoid(np.clip(eta, -30, 30))
    c = np.exp(np.clip(log_conc, -10, 14))
    a, b = np.maximum(c * p, 1e-10), np.maximum(c * (1 - p), 1e-10)
    value = special.log_beta_binomial(y, n, a, b)
    a1 = special.digamma(y + a) - special.digamma(a)
    b1 = special.digamma(n - y + b) - special.digamma(b)
    c1 = special.digamma(n + c) - special.digamma(c)
    a2 = special.trigamma(y + a) - special.trigamma(a)
    b2 = special.trigamma(n - y + b) - special.trigamma(b)
    c2 = special.trigamma(n + c) - special.trigamma(c)
    slope = c * p * (1 - p)
    d_eta = slope * (a1 - b1)
    d_lambda = a * a1 + b * b1 - c * c1
    h_eta = slope**2 * (a2 + b2) + slope * (1 - 2 * p) * (a1 - b1)
    h_cross = slope * (a1 - b1) + slope * (a * a2 - b * b2)
    h_lambda = a * a1 + a * a * a2 + b * b1 + b * b * b2 - c * c1 - c * c * c2
    return value, (d_eta, d_lambda), (h_eta, h_cross, h_lambda)


def binomial_parts(y, n, eta):
    """Binomial log probability with its first and second derivative in the logit."""
    eta = np.clip(eta, -30, 30)
    p = special.sigmoid(eta)
    choose = special.gammaln(n + 1.0) - special.gammaln(y + 1.0) - special.gammaln(n - y + 1.0)
    value = choose + y * eta - n * np.logaddexp(0.0, eta)
    return value, y - n * p, -n * p * (1 - p)


def conc_prior(column: int, shape: float, rate: float):
    """Gamma prior on a concentration, with the log concentration in a parameter column."""

    def prior(theta):
        c = np.exp(np.clip(theta[:, column], -10, 14))
        value = (shape - 1) * np.log(c) - rate * c
        grad, hess = np.zeros_like(theta), np.zeros((*theta.shape, theta.shape[1]))
        grad[:, column] = (shape - 1) - rate * c
        hess[:, column, column] = -rate * c
        return value, grad, hess

    return prior


def _allelic_terms(family: str):
    def terms(frame, theta):
        y, n = frame["_y"].to_numpy(dtype=float), frame["_n"].to_numpy(dtype=float)
        w = frame["_w"].to_numpy(dtype=float)
        sides = []
        for sign in (1.0, -1.0) if family.startswith("folded") else (1.0,):
            if family.endswith("beta_binomial"):
                v, (d, dl), (h, hx, hl) = beta_binomial_parts(y, n, sign * theta[:, 0], theta[:, 1])
                grad = np.column_stack([sign * d, dl])
                hess = np.stack(
                    [np.column_stack([h, sign * hx]), np.column_stack([sign * hx, hl])], axis=1
                )
            else:
                v, d, h = binomial_parts(y, n, sign * theta[:, 0])
                grad, hess = (sign * d)[:, None], h[:, None, None]
            sides.append((v, grad, hess))
        if len(sides) == 1:
            value, grad, hess = sides[0]
        else:
            (v1, g1, h1), (v2, g2, h2) = sides
            value = np.logaddexp(v1, v2)
            r1 = np.exp(v1 - value)[:, None]
            gap = g1 - g2
            grad = r1 * g1 + (1 - r1) * g2
            mix = (r1 * (1 - r1))[:, :, None] * gap[:, :, None] * gap[:, None, :]
            hess = r1[:, :, None] * h1 + (1 - r1)[:, :, None] * h2 + mix
            if family == "folded_binomial":
                value = value + np.where(2 * y == n, np.log(0.5), 0.0)
        return w * value, w[:, None] * grad, w[:, None, None] * hess

    return terms


def grouped_allelic_mean(
    ase: DataFrame,
    by: Sequence[str],
    *,
    family: str = "folded_binomial",
    alt: str = "allele_count",
    total: str = "total_count",
) -> DataFrame:
    """Maximum-likelihood mean allelic fraction of the minor counts of each group.

    Families: binomial, folded_binomial, beta_binomial, folded_beta_binomial. Entries of one
    read are dropped. Equal (count, depth) entries are merged first. A folded likelihood is
    symmetric around one half, and the smaller fraction is given. ``converged`` tells whether the
    steps of an iterative family have settled.
    """
    minor = F.least(F.col(alt), F.col(total) - F.col(alt))
    entries = (
        ase.where(F.col(total) > 1)
        .groupBy(*by, minor.alias("_y"), F.col(total).alias("_n"))
        .agg(F.count("*").alias("_w"))
    )
    ratio = F.sum(F.col("_y") * F.col("_w")) / F.sum(F.col("_n") * F.col("_w"))
    if family == "binomial":
        return entries.groupBy(*by).agg(ratio.alias("mean"))
    if family not in ("folded_binomial", "beta_binomial", "folded_beta_binomial"):
        raise ValueError(f"unknown family {family}")
    entries = cut_lineage(entries)
    conc = family.endswith("beta_binomial")
    # start left of one half: that point is stationary for a folded likelihood
    inside = F.greatest(F.lit(0.001), F.least(F.lit(0.45), ratio))
    logit = F.log(inside / (1 - inside))
    start = entries.groupBy(*by).agg(
        (F.array(logit, F.lit(3.0)) if conc else F.array(logit)).alias("theta")
    )
    fit = newton_by_key(
        entries,
        start,
        by,
        2 if conc else 1,
        _allelic_terms(family),
        prior=conc_prior(1, CONC_SHAPE, CONC_RATE) if conc else None,
        tol=1e-13,
    )
    p = 1 / (1 + F.exp(-F.col("theta")[0]))
    mean = F.least(p, 1 - p) if family.startswith("folded") else p
    out = fit.select(*by, mean.alias("mean"), "ll", "converged", *([F.exp(F.col("theta")[1]).alias("concentration")] if conc else []))
    return out
