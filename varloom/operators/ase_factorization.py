"""Factorizations of allelic ratios from the observed entries only.

Sites and cells are fitted in turn by damped Newton steps for all keys at once; the rows
are only ever seen in batches (see ``varloom.plans.newton``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.operators.count_models import (
    CONC_RATE,
    CONC_SHAPE,
    beta_binomial_parts,
    binomial_parts,
    conc_prior,
)
from varloom.operators.factorization import _normal_draw
from varloom.plans.newton import newton_by_key
from varloom.plans.scale import broadcast_if_small, cut_lineage, settled

# fixed values: pseudo-count of the phase weights, base shape of the skewed components
PSEUDO_COUNT, SKEW_BASE = 5.0, 7.0


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _chain(x, value, d, h, extra=None):
    """Gradient and Hessian in the coefficients from derivatives in the linear predictor;
    ``extra`` holds the derivatives of the leading log concentration."""
    p = x.shape[1]
    hess = h[:, None, None] * x[:, :, None] * x[:, None, :]
    if extra is None:
        return value, d[:, None] * x, hess
    dl, hx, hl = extra
    grad = np.column_stack([dl, d[:, None] * x])
    full = np.zeros((len(x), p + 1, p + 1))
    full[:, 1:, 1:] = hess
    full[:, 0, 1:] = full[:, 1:, 0] = hx[:, None] * x
    full[:, 0, 0] = hl
    return value, grad, full


def _sides(frame, family, eta, lam, phase):
    """Weighted sum (phase mixture) or log sum (folded) of the two orientations."""
    y, n = frame["_y"].to_numpy(dtype=float), frame["_n"].to_numpy(dtype=float)
    if family == "folded_binomial":
        v1, d1, h1 = binomial_parts(y, n, eta)
        v2, d2, h2 = binomial_parts(y, n, -eta)
        value = np.logaddexp(v1, v2) + np.where(2 * y == n, np.log(0.5), 0.0)
        r = np.exp(v1 - np.logaddexp(v1, v2))
        d = r * d1 - (1 - r) * d2
        h = r * h1 + (1 - r) * h2 + r * (1 - r) * (d1 + d2) ** 2
        return value, d, h, None
    v1, (d1, l1), (h1, x1, c1) = beta_binomial_parts(y, n, eta, lam)
    if not phase:
        return v1, d1, h1, (l1, x1, c1)
    v2, (d2, l2), (h2, x2, c2) = beta_binomial_parts(y, n, -eta, lam)
    w1, w2 = frame["_w1"].to_numpy(dtype=float), frame["_w2"].to_numpy(dtype=float)
    return (
        w1 * v1 + w2 * v2,
        w1 * d1 - w2 * d2,
        w1 * h1 + w2 * h2,
        (w1 * l1 + w2 * l2, w1 * x1 - w2 * x2, w1 * c1 + w2 * c2),
    )


def _site_terms(family: str, fixed_conc: bool, phase: bool):
    def terms(frame, theta):
        x = _stack(frame["_x"])
        free = family == "beta_binomial" and not fixed_conc
        beta = theta[:, 1:] if free else theta
        if family == "folded_binomial":
            lam = None
        else:
            lam = theta[:, 0] if free else np.log(frame["_conc"].to_numpy(dtype=float))
        eta = np.einsum("bi,bi->b", x, beta)
        value, d, h, extra = _sides(frame, family, eta, lam, phase)
        return _chain(x, value, d, h, extra if free else None)

    return terms


def _cell_terms(family: str, phase: bool):
    def terms(frame, theta):
        x = _stack(frame["_x"])
        eta = frame["_offset"].to_numpy(dtype=float) + np.einsum("bi,bi->b", x, theta)
        lam = None if family == "folded_binomial" else np.log(frame["_conc"].to_numpy(dtype=float))
        value, d, h, _ = _sides(frame, family, eta, lam, phase)
        return _chain(x, value, d, h)

    return terms


def _start(ase, cells, k, seed, site, sample, alt, total, cov):
    data = cut_lineage(
        ase.where(F.col(total) > 0).select(
            F.col(site).alias("site"),
            F.col(sample).alias("sample"),
            F.col(alt).cast("double").alias("_y"),
            F.col(total).cast("double").alias("_n"),
            *([F.col("z")] if "z" in ase.columns else []),
        )
    )
    names = data.select("sample").distinct()
    c = F.array(F.lit(1.0), *[F.col(x).cast("double") for x in cov])
    if cov:
        names = names.join(cells.select(F.col(sample).alias("sample"), *cov), "sample")
    u = F.array(*_normal_draw(seed + 1, "sample", k))
    state = cut_lineage(names.select("sample", c.alias("cov"), u.alias("u")))
    ratio = F.col("_y") / F.col("_n")
    mean = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.avg(ratio)))
    spread = F.var_pop(ratio)
    conc = F.least(F.lit(1000.0), F.when(spread > 0, 1 / spread).otherwise(1000.0))
    sites = data.groupBy("site").agg(
        F.log(mean / (1 - mean)).alias("_b0"), conc.alias("_conc")
    )
    # weights of the factors start small, so that neither half-step begins at a flat point
    v = [x * 0.1 for x in _normal_draw(seed + 3, "site", k)]
    beta = F.array(F.col("_b0"), *[F.lit(0.0)] * len(cov), *v)
    return data, state, cut_lineage(sites.select("site", beta.alias("beta"), "_conc"))


def _split(theta: str, n_cov: int, k: int):
    return F.slice(theta, 1, n_cov), F.slice(theta, n_cov + 1, k)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ase_als(
    ase: DataFrame,
    k: int,
    *,
    cells: DataFrame | None = None,
    cov: Sequence[str] = (),
    family: str = "beta_binomial",
    concentration: float | None = None,
    iterations: int = 20,
    tolerance: float | None = None,
    newton_steps: int = 8,
    seed: int = 0,
    site: str = "site_id",
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Alternate maximum-likelihood fits: per site the coefficients of (1, covariates,
    loadings) and the concentration, per cell the loadings.

    ``concentration`` fixes it for all sites; ``family`` may be "folded_binomial" for counts
    of the rarer allele. Returns loadings, site parameters and the log-likelihood history. With a
    ``tolerance`` the fit ends when an iteration changes that by less than this share of it;
    ``iterations`` entries tell that it has not settled.
    """
    if family not in ("beta_binomial", "folded_binomial"):
        raise ValueError(f"unknown family {family}")
    data, state, sites = _start(ase, cells, k, seed, site, sample, alt, total, list(cov))
    n_cov = 1 + len(cov)
    fixed = concentration is not None
    if fixed:
        sites = cut_lineage(sites.withColumn("_conc", F.lit(float(concentration))))
    free = family == "beta_binomial" and not fixed
    width = n_cov + k + (1 if free else 0)
    history: list[float] = []
    for _ in range(iterations):
        sites, _ll = _site_step(data, state, sites, family, fixed, False, width, newton_steps)
        state, ll = _cell_step(data, state, sites, family, False, n_cov, k, newton_steps)
        history.append(ll)
        if settled(history, tolerance):
            break
    cov_part, v_part = _split("beta", n_cov, k)
    out = sites.select(
        F.col("site").alias(site), cov_part.alias("c"), v_part.alias("v"), F.col("_conc").alias("concentration")
    )
    return state.select(F.col("sample").alias(sample), "u"), out, history


def _site_step(data, state, sites, family, fixed, phase, width, steps):
    free = family == "beta_binomial" and not fixed
    rows = data.join(
        broadcast_if_small(state.select("sample", F.concat("cov", "u").alias("_x"))), "sample"
    )
    if family == "beta_binomial" and fixed:
        rows = rows.join(broadcast_if_small(sites.select("site", "_conc")), "site")
    start = sites.select(
        "site",
        (F.concat(F.array(F.log("_conc")), F.col("beta")) if free else F.col("beta")).alias("theta"),
    )
    fit = newton_by_key(
        rows, start, ["site"], width, _site_terms(family, fixed, phase),
        prior=conc_prior(0, CONC_SHAPE, CONC_RATE) if free else None, max_iter=steps, tol=1e-6,
    )
    if free:
        new = fit.select("site", F.slice("theta", 2, width - 1).alias("beta"), F.exp(F.col("theta")[0]).alias("_conc"), "ll")
    else:
        new = fit.select("site", F.col("theta").alias("beta"), "ll").join(
            sites.select("site", "_conc"), "site"
        )
    new = cut_lineage(new)
    ll = float(new.agg(F.sum("ll")).head()[0])
    return new.drop("ll"), ll


def _cell_step(data, state, sites, family, phase, n_cov, k, steps):
    cov_part, v_part = _split("beta", n_cov, k)
    params = sites.select("site", cov_part.alias("_c"), v_part.alias("_x"), "_conc")
    rows = (
        data.join(broadcast_if_small(params), "site")
        .join(broadcast_if_small(state.select("sample", "cov")), "sample")
        .withColumn("_offset", _dot("cov", "_c"))
        .drop("_c", "cov")
    )
    start = state.select("sample", F.col("u").alias("theta"))
    fit = newton_by_key(
        rows, start, ["sample"], k, _cell_terms(family, phase), max_iter=steps, tol=1e-6
    )
    fit = cut_lineage(fit.select("sample", F.col("theta").alias("u"), "ll"))
    new = cut_lineage(state.select("sample", "cov").join(fit.select("sample", "u"), "sample"))
    return new, float(fit.agg(F.sum("ll")).head()[0])


def _skew_terms(column: str, flip: bool):
    """Weighted log BB(y; 1, 7 + a) in log a, of the counts or of their complement."""

    def terms(frame, theta):
        y, n = frame["_y"].to_numpy(dtype=float), frame["_n"].to_numpy(dtype=float)
        w = frame[column].to_numpy(dtype=float)
        y = n - y if flip else y
        a = np.exp(np.clip(theta[:, 0], -12, 12))
        b = SKEW_BASE + a
        value = special.log_beta_binomial(y, n, np.ones_like(b), b)
        d = special.digamma(n - y + b) - special.digamma(b) - special.digamma(n + 1 + b) + special.digamma(1 + b)
        d2 = special.trigamma(n - y + b) - special.trigamma(b) - special.trigamma(n + 1 + b) + special.trigamma(1 + b)
        return w * value, (w * d * a)[:, None], (w * (d * a + d2 * a * a))[:, None, None]

    return terms


def _cauchy_prior(scale: float):
    def prior(theta):
        a = np.exp(np.clip(theta[:, 0], -12, 12))
        q = (a / scale) ** 2
        grad = -2 * q / (1 + q)
        hess = -4 * q / (1 + q) ** 2
        return -np.log1p(q), grad[:, None], hess[:, None, None]

    return prior


def ase_em(
    ase: DataFrame,
    k: int,
    *,
    individual: str = "individual_id",
    cells: DataFrame | None = None,
    cov: Sequence[str] = (),
    iterations: int = 20,
    tolerance: float | None = None,
    newton_steps: int = 6,
    cauchy_scale: float = 2.0,
    seed: int = 0,
    site: str = "site_id",
    sample: str = "sample_id",
    alt: str = "allele_count",
    total: str = "total_count",
) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """Phase mixture by EM. A (donor, site) is phased, flipped, or skewed to one side:
    BB(c p, c (1 - p)), BB(c (1 - p), c p), BB(1, 7 + a1) or BB(7 + a2, 1).

    The E-step adds the log probabilities of the donor's cells; the M-step weights the fits
    of ``ase_als`` by the responsibilities. Returns loadings, site parameters, responsibilities
    and the observed-data log-likelihood by iteration.
    """
    data, state, sites = _start(
        ase.withColumnRenamed(individual, "z"), cells, k, seed, site, sample, alt, total, list(cov)
    )
    n_cov = 1 + len(cov)
    # responsibilities start at even weights; components 3 and 4 at their base shape
    sites = cut_lineage(
        sites.withColumns(
            {
                "_a1": F.lit(1.0),
                "_a2": F.lit(1.0),
                "_pi": F.array(*[F.lit(0.25)] * 4),
            }
        )
    )
    types = {c: data.schema[c].dataType.simpleString() for c in ("site", "z")}
    history: list[float] = []
    phi = None
    for _ in range(iterations):
        params = sites.select("site", "beta", "_conc", "_a1", "_a2")
        rows = (
            data.join(broadcast_if_small(params), "site")
            .join(broadcast_if_small(state.select("sample", F.concat("cov", "u").alias("_x"))), "sample")
            .withColumn("_eta", _dot("_x", "beta"))
            .select("site", "z", "_y", "_n", "_eta", "_conc", "_a1", "_a2")
        )

        def states(frames):
            for frame in frames:
                y, n = frame["_y"].to_numpy(), frame["_n"].to_numpy()
                p = special.sigmoid(frame["_eta"].to_numpy())
                c = frame["_conc"].to_numpy()
                a, b = np.maximum(c * p, 1e-10), np.maximum(c * (1 - p), 1e-10)
                one = np.ones_like(y)
                out = frame[["site", "z"]].copy()
                out["l1"] = special.log_beta_binomial(y, n, a, b)
                out["l2"] = special.log_beta_binomial(y, n, b, a)
                out["l3"] = special.log_beta_binomial(y, n, one, SKEW_BASE + frame["_a1"].to_numpy())
                out["l4"] = special.log_beta_binomial(y, n, SKEW_BASE + frame["_a2"].to_numpy(), one)
                yield out

        logs = rows.mapInPandas(
            states,
            f"site {types['site']}, z {types['z']}, l1 double, l2 double, l3 double, l4 double",
        )
        summed = logs.groupBy("site", "z").agg(F.array(*[F.sum(f"l{i}") for i in (1, 2, 3, 4)]).alias("l"))
        weighted = summed.join(broadcast_if_small(sites.select("site", "_pi")), "site").withColumn(
            "l", F.zip_with("l", "_pi", lambda a, b: a + F.log(b))
        )
        shift = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
        norm = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
        phi = cut_lineage(
            weighted.withColumn("_e", shift).select(
                "site",
                "z",
                F.transform("_e", lambda x: x / norm).alias("phi"),
                (F.array_max("l") + F.log(norm)).alias("_ll"),
            )
        )
        history.append(float(phi.agg(F.sum("_ll")).head()[0]))
        totals = phi.groupBy("site").agg(
            F.array(*[F.sum(F.col("phi")[i]) + PSEUDO_COUNT for i in range(4)]).alias("_t")
        )
        whole = F.aggregate("_t", F.lit(0.0), lambda s, x: s + x)
        pi = totals.select("site", F.transform("_t", lambda x: x / whole).alias("_pi"))
        seen = data.join(broadcast_if_small(phi.select("site", "z", "phi")), ["site", "z"]).select(
            "site", "sample", "_y", "_n", *[F.col("phi")[i].alias(f"_w{i + 1}") for i in range(4)]
        )
        seen = cut_lineage(seen)
        base, _ = _site_step(
            seen, state, sites.select("site", "beta", "_conc"), "beta_binomial", False, True,
            n_cov + k + 1, newton_steps,
        )
        skews = []
        for column, flip, name in (("_w3", False, "_a1"), ("_w4", True, "_a2")):
            fit = newton_by_key(
                seen, sites.select("site", F.array(F.log(name)).alias("theta")), ["site"], 1,
                _skew_terms(column, flip), prior=_cauchy_prior(cauchy_scale), max_iter=newton_steps, tol=1e-6,
            )
            skews.append(fit.select("site", F.exp(F.col("theta")[0]).alias(name)))
        sites = cut_lineage(base.join(skews[0], "site").join(skews[1], "site").join(pi, "site"))
        state, _ = _cell_step(
            seen, state, sites.select("site", "beta", "_conc"), "beta_binomial", True, n_cov, k, newton_steps
        )
        if settled(history, tolerance):
            break
    cov_part, v_part = _split("beta", n_cov, k)
    out = sites.select(
        F.col("site").alias(site), cov_part.alias("c"), v_part.alias("v"),
        F.col("_conc").alias("concentration"), F.col("_a1").alias("a1"), F.col("_a2").alias("a2"),
        F.col("_pi").alias("weights"),
    )
    return (
        state.select(F.col("sample").alias(sample), "u"),
        out,
        phi.select(F.col("site").alias(site), F.col("z").alias(individual), "phi"),
        history,
    )
