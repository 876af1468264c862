"""Factor models of genotype effects over long tables of observations.

The model of an observation is

    y = intercept[t] + alpha[z(n), t] + C[t].c[n] + g * (F[t] + U[n].V[t]) + U[n].Delta[t]

Every update of the parameters of a test needs only cross products of its observations with
the (expected) loadings, and every update of a sample only cross products with the
parameters of the tests. One iteration is therefore two grouped sums in the JVM, each
followed by closed-form updates on one row per sample or per test. Observations and samples lie
in buckets by sample, so that no iteration shuffles them. A test that holds a third of all
observations is combined map-side like any other; where a sample holds more than a bucket should,
nothing is bucketed and its observations are combined map-side, too.

Random intercepts are rows of their own, by test, grouping and level. They are updated between
two halves of the tests' step: sums by level meet the tests' coefficients by an equi-join,
and what the coefficients need of the intercepts is a sum by test again. No row grows with
the number of levels.

Input: ``obs(test, sample, g, y)`` and ``samples(sample, [groups], [c array])``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.operators.joins import index_labels
from varloom.operators.mixed import OneGrouping, _best_ratio, _profile
from varloom.operators.regression import replicate_samples
from varloom.plans.scale import (
    broadcast_if_small,
    bucketed,
    buckets_for,
    cut_lineage,
    discard,
    hash_order,
    settled,
)

_CHUNK = 256  # tests updated together inside a task


@dataclass(frozen=True)
class Options:
    """Choices of the variational model."""

    k: int
    groups: tuple[str, ...] = ()  # none, one or two random intercepts
    n_covariates: int = 0  # entries of the covariate array ``c``
    learn_covariates: int = 0  # latent covariates re-estimated by sample
    loading: str = "spike"  # spike, gaussian, binary or dirichlet
    factor_spike: bool = False
    environment_effect: bool = False
    genotype_intercept: bool = True
    ard: str = "none"  # none, factors, loadings or both
    tied_residual: bool = False
    zero_inflated: bool = False
    svi_fraction: float | None = None
    learning_rate: float = 0.4
    forgetting_rate: float = 0.01
    init: str = "random"  # random, categories, regression or mixed
    init_category: str | None = None
    warmup: int = 5
    seed: int = 0
    # fixed values: prior precisions and shapes
    gamma_v: float = 1.0
    gamma_u: float = 1.0
    gamma_f: float = 0.01
    shape: float = 1e-3
    rate: float = 1e-3
    a: float = 1.0
    b: float = 1.0
    dirichlet: float = 1.1

    @property
    def n_c(self) -> int:
        return self.n_covariates + self.learn_covariates

    @property
    def width(self) -> int:
        return 2 + self.n_c + self.k * (2 if self.environment_effect else 1)

    @property
    def v(self) -> slice:
        return slice(2 + self.n_c, 2 + self.n_c + self.k)

    @property
    def d(self) -> slice:
        return slice(2 + self.n_c + self.k, self.width)


@dataclass
class Fit:
    """State of a fitted model: keyed tables and a few global numbers."""

    samples: DataFrame
    tests: DataFrame
    options: Options
    theta_a: np.ndarray
    theta_b: np.ndarray
    gamma_u: np.ndarray
    gamma_v: np.ndarray
    elbo: list[float] = field(default_factory=list)
    obs: DataFrame | None = None
    theta_va: np.ndarray | None = None
    theta_vb: np.ndarray | None = None
    effects: DataFrame | None = None  # random intercepts by test, grouping r and level z
    converged: bool | None = None  # whether the bound settled; None without a tolerance


def _normal_draw(seed: int, key: str, k: int) -> list[Column]:
    """Reproducible standard normal columns from hashes (Box-Muller)."""
    out = []
    for i in range(k):
        h = hash_order(seed * 1009 + i, key)
        u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)
        u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / 2.0**32
        out.append(F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * u2))
    return out


def _by_sample(data: DataFrame) -> tuple[DataFrame, int | None]:
    """The observations in buckets by sample and their number, if no sample has too many."""
    rows = data.count()
    n = buckets_for(rows, data.sparkSession)
    most = data.groupBy("sample").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    if most > max(rows // n, 10_000):
        return data, None
    return bucketed(data, "sample", n, replaces=data), n


def _kept(df: DataFrame, n: int | None, *, replaces: DataFrame | None = None, dealt: bool = True) -> DataFrame:
    """A table by sample, written with the buckets of the observations if they have any."""
    if n is None:
        return cut_lineage(df, replaces=replaces)
    return bucketed(df, "sample", n, in_place=dealt, replaces=replaces)


def _triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _full(flat: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(flat), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _design(o: Options) -> list[tuple[Column, tuple[str, int] | None]]:
    """Multiplier and latent of each coefficient of a test, in order."""
    g, one = F.col("g"), F.lit(1.0)
    terms: list = [(one, None), (g, None)]
    terms += [(one, ("c", j)) for j in range(o.n_c)]
    terms += [(g, ("u", k)) for k in range(o.k)]
    if o.environment_effect:
        terms += [(one, ("u", k)) for k in range(o.k)]
    return terms


def _mean(latent) -> Column:
    return F.lit(1.0) if latent is None else F.col(latent[0])[latent[1]]


def _design_sums(obs: DataFrame, samples: DataFrame, o: Options, keys: Sequence[str]) -> DataFrame:
    """Expected cross products of the observations of each key with the design."""
    columns = ["sample", "u", "u2", *(["c", "c2"] if o.n_c else []), *[f"_g{r}" for r in range(len(o.groups))]]
    if o.svi_fraction:
        columns.append("_scale")
    small = broadcast_if_small(samples.select(*columns), width=2 * (o.k + o.n_c) + 4)
    joined = obs.join(small, "sample")
    w = F.col("w") if o.zero_inflated else F.lit(1.0)
    terms, y = _design(o), F.col("y")
    gram = []
    for i, j in _triangle(len(terms)):
        (mi, li), (mj, lj) = terms[i], terms[j]
        second = F.col(f"{li[0]}2")[li[1]] if li is not None and li == lj else _mean(li) * _mean(lj)
        gram.append(F.sum(w * mi * mj * second))
    xy = [F.sum(w * y * m * _mean(latent)) for m, latent in terms]
    return joined.groupBy(*keys).agg(
        F.array(*gram).alias("gram"),
        F.array(*xy).alias("xy"),
        F.sum(w * y * y).alias("yy"),
        (F.max("_scale") if o.svi_fraction else F.max(F.lit(1.0))).alias("up"),
    )


def _test_sums(obs: DataFrame, samples: DataFrame, o: Options) -> DataFrame:
    """Expected cross products of each test with the design."""
    return _design_sums(obs, samples, o, ["test"]).drop("up")


def _sum_of(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


# --- random intercepts -----------------------------------------------------------------------


def _start_effects(obs: DataFrame, samples: DataFrame, o: Options) -> DataFrame:
    """One row for every level in which a test has observations."""
    names = [f"_g{r}" for r in range(len(o.groups))]
    cells = obs.join(broadcast_if_small(samples.select("sample", *names)), "sample").select("test", *names)
    each = [F.struct(F.lit(r).alias("r"), F.col(g).cast("long").alias("z")) for r, g in enumerate(names)]
    pairs = cells.distinct().select("test", F.explode(F.array(*each)).alias("e")).select("test", "e.r", "e.z")
    start = pairs.distinct().select("test", "r", "z", F.lit(0.0).alias("alpha"), F.lit(1e-7).alias("avar"))
    return cut_lineage(start)


def _levels(cells: DataFrame, effects: DataFrame, o: Options) -> DataFrame:
    """The intercepts with the sums of their observations: design x, y and weight up.

    A level without observations in this step has zeros.
    """
    p = o.width
    parts = []
    for r in range(len(o.groups)):
        sums = cells.groupBy("test", F.col(f"_g{r}").cast("long").alias("z")).agg(
            _sum_of("gram", p).alias("x"), F.sum(F.col("xy")[0]).alias("ly"), F.max("up").alias("up")
        )
        parts.append(sums.withColumn("r", F.lit(r)))
    now = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return cut_lineage(
        effects.join(now, ["test", "r", "z"], "left").select(
            "test", "r", "z", "alpha", "avar",
            F.coalesce("x", F.array_repeat(F.lit(0.0), p)).alias("x"),
            F.coalesce("ly", F.lit(0.0)).alias("ly"),
            F.coalesce("up", F.lit(1.0)).alias("up"),
            F.lit(0.0).alias("cross"),
        )
    )


def _pulled(p: int) -> Column:
    """What the intercepts take from the cross products of a test with y."""
    return F.array(*[F.sum(F.col("alpha") * F.col("up") * F.col("x")[i]) for i in range(p)])


def _new_effects(
    levels: DataFrame, tests: DataFrame, cells: DataFrame, o: Options, r: int, rho: float, tau: float | None
) -> DataFrame:
    """The intercepts of grouping r, given the coefficients and those of the other grouping."""
    p = o.width
    precision = F.lit(tau) if tau is not None else F.col("tau_a") / F.col("tau_b")
    params = tests.select(
        "test", "m", precision.alias("_tau"), (F.col("psi_a")[r] / F.col("psi_b")[r]).alias("_psi")
    )
    own = levels.where(F.col("r") == r)
    if len(o.groups) == 2:
        other = levels.where(F.col("r") == 1 - r).select("test", F.col("z").alias("_o"), F.col("alpha").alias("_a"))
        met = cells.select(
            "test",
            F.col(f"_g{r}").cast("long").alias("z"),
            F.col(f"_g{1 - r}").cast("long").alias("_o"),
            F.col("gram")[0].alias("_n"),
        ).join(other, ["test", "_o"])
        cross = met.groupBy("test", "z").agg(F.sum(F.col("_n") * F.col("_a")).alias("_cross"))
        own = own.join(cross, ["test", "z"], "left").withColumn("cross", F.coalesce("_cross", F.lit(0.0)))
    rest = F.col("ly") - F.col("cross")
    for i in range(p):
        rest = rest - F.col("x")[i] * F.col("m")[i]
    var = 1.0 / (F.col("up") * F.col("x")[0] * F.col("_tau") + F.col("_psi"))
    mean = var * F.col("_tau") * F.col("up") * rest
    if rho < 1:
        var = (1 - rho) * F.col("avar") + rho * var
        mean = (1 - rho) * F.col("alpha") + rho * mean
    joined = own.join(broadcast_if_small(params, width=p + 4), "test")
    return cut_lineage(
        joined.select(
            "test", "r", "z", mean.alias("alpha"), var.alias("avar"), "x", "ly", "up", "cross"
        )
    )


def _effect_sums(levels: DataFrame, o: Options) -> DataFrame:
    """By test, all that the coefficients, variances and the bound need of the intercepts."""
    a, v = F.col("alpha"), F.col("avar")
    second = a * a + v

    def by_group(value: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("r") == r, value).otherwise(0.0)) for r in range(len(o.groups))])

    return levels.groupBy("test").agg(
        _pulled(o.width).alias("pull"),
        F.sum(a * F.col("up") * F.col("ly")).alias("ay"),
        F.sum(F.col("up") * F.col("x")[0] * second).alias("spread"),
        # the last grouping's rows hold what they share with the first one's
        F.sum(F.when(F.col("r") == 1, a * F.col("cross")).otherwise(0.0)).alias("both"),
        by_group(second).alias("second"),
        by_group(F.log(v)).alias("logs"),
        by_group(F.lit(1.0)).alias("count"),
    )


def _size_moments(levels: DataFrame, p: int) -> DataFrame:
    """The first grouping's levels merged by their numbers of observations, as a list by test."""
    x = [F.col("x")[i] for i in range(p)] + [F.col("ly")]
    merged = levels.where("r = 0").groupBy("test", F.col("x")[0].alias("n")).agg(
        F.count("*").cast("double").alias("m"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in _triangle(p + 1)]).alias("outer"),
    )
    return merged.groupBy("test").agg(F.collect_list(F.struct("n", "m", "outer")).alias("classes"))


_TEST_SCHEMA = (
    "test {t}, m array<double>, m2 array<double>, var array<double>, mu_v array<double>, "
    "s_v array<double>, idle array<double>, "
    "psi_a array<double>, psi_b array<double>, tau_a double, tau_b double, "
    "ls_a double, ls_b double, n double, rss double, part double"
)
_MID_SCHEMA = _TEST_SCHEMA + ", gram array<double>, xy array<double>, yy double"


class _TestStep:
    """Closed-form updates of all parameters of a block of tests.

    With random intercepts the step has two halves: ``before`` updates the effects that
    interact with the loadings, ``after`` the intercept, the genotype and the covariates, the
    variances and the bound, when the random intercepts have moved.
    """

    def __init__(self, o: Options, sizes, gamma_v, theta_v, tau, step, full_n, first):
        self.o, self.sizes, self.gamma_v, self.theta_v = o, sizes, gamma_v, theta_v
        self.tau, self.step, self.full_n, self.first = tau, step, full_n, first

    def _chunks(self, frames):
        for frame in frames:
            for at in range(0, len(frame), _CHUNK):
                yield frame.iloc[at : at + _CHUNK].reset_index(drop=True)

    def whole(self, frames):
        for frame in self._chunks(frames):
            yield self.after(self.before(frame))

    def before_all(self, frames):
        for frame in self._chunks(frames):
            yield self.before(frame)

    def after_all(self, frames):
        for frame in self._chunks(frames):
            yield self.after(frame)

    def read(self, frame):
        o, p = self.o, self.o.width
        scale = 1.0 / o.svi_fraction if o.svi_fraction else 1.0
        self.gram, self.xy = _full(_stack(frame["gram"]), p) * scale, _stack(frame["xy"]) * scale
        self.m, self.m2, self.var = _stack(frame["m"]), _stack(frame["m2"]), _stack(frame["var"])
        self.mu_v, self.s_v = _stack(frame["mu_v"]), _stack(frame["s_v"])
        self.now = (
            np.full(len(frame), self.tau)
            if self.tau is not None
            else frame["tau_a"].to_numpy(dtype=float) / frame["tau_b"].to_numpy(dtype=float)
        )
        self.pull = _stack(frame["pull"]) if o.groups else np.zeros_like(self.xy)
        return scale

    def blend(self, old, new):
        return new if self.step >= 1 else (1 - self.step) * old + self.step * new

    def coefficient(self, j, precision, spike=None):
        gram, m, m2, var, tau = self.gram, self.m, self.m2, self.var, self.now
        rest = self.xy[:, j] - np.einsum("bl,bl->b", gram[:, j], m) + gram[:, j, j] * m[:, j] - self.pull[:, j]
        a = precision + tau * gram[:, j, j]
        good = a > 1e-300
        new_var = np.where(good, 1.0 / np.where(good, a, 1.0), var[:, j])
        new_mu = new_var * tau * rest
        var[:, j] = self.blend(var[:, j], new_var)
        if spike is None:
            m[:, j] = self.blend(m[:, j], new_mu)
            m2[:, j] = m[:, j] ** 2 + var[:, j]
        else:
            odds = spike[1] + 0.5 * np.log(precision) - 0.5 * np.log(a) + (tau * rest) ** 2 / (2 * a)
            k, mu_v, s_v = spike[0], self.mu_v, self.s_v
            mu_v[:, k] = self.blend(mu_v[:, k], new_mu)
            s_v[:, k] = self.blend(s_v[:, k], special.sigmoid(odds))
            m[:, j] = mu_v[:, k] * s_v[:, k]
            m2[:, j] = s_v[:, k] * (mu_v[:, k] ** 2 + var[:, j])

    def written(self, frame, names):
        out = frame[names].copy()
        for name in ("m", "m2", "var", "mu_v", "s_v"):
            out[name] = list(getattr(self, name))
        return out

    def before(self, frame):
        o = self.o
        self.read(frame)
        if self.first and o.init in ("regression", "mixed"):
            self.start(frame)
        for k in range(o.k):
            spike = None
            if o.factor_spike:
                ta, tb = self.theta_v
                spike = (k, special.digamma(ta[k]) - special.digamma(tb[k]))
            self.coefficient(o.v.start + k, self.gamma_v[k], spike)
        if o.environment_effect:
            for k in range(o.k):
                self.coefficient(o.d.start + k, o.gamma_v)
        rest = "test idle psi_a psi_b tau_a tau_b ls_a ls_b n rss part gram xy yy".split()
        return self.written(frame, rest)

    def after(self, frame):
        o = self.o
        scale = self.read(frame)
        gram, xy, n_re = self.gram, self.xy, len(o.groups)
        yy = frame["yy"].to_numpy(dtype=float) * scale
        n = gram[:, 0, 0].copy()
        self.coefficient(0, 0.0)
        if o.genotype_intercept:
            self.coefficient(1, o.gamma_f)
        for j in range(o.n_c):
            self.coefficient(2 + j, o.gamma_v)
        m, m2 = self.m, self.m2
        psi_a, psi_b, idle = (_stack(frame[c]) if n_re else np.zeros((len(frame), 0)) for c in ("psi_a", "psi_b", "idle"))
        second = logs = None
        if n_re:
            # levels without any observation of the test stay at zero with the prior's variance
            idle = self.blend(idle, psi_b / psi_a)
            unseen = np.array(self.sizes, float) - _stack(frame["count"])
            second = _stack(frame["second"]) + unseen * idle
            logs = _stack(frame["logs"]) + unseen * np.log(idle)
            psi_a = np.tile(o.shape + np.array(self.sizes) / 2.0, (len(frame), 1))
            psi_b = o.rate + second / 2.0
        # expected squared residuals
        rss = yy - 2 * np.einsum("bp,bp->b", m, xy) + np.einsum("bp,bpq,bq->b", m, gram, m)
        rss += np.einsum("bpp,bp->b", gram, m2 - m**2)
        if n_re:
            rss += frame["spread"].to_numpy(dtype=float)
            rss -= 2 * (frame["ay"].to_numpy(dtype=float) - np.einsum("bp,bp->b", m, self.pull))
            rss += 2 * frame["both"].to_numpy(dtype=float) * scale
        tau_a = self.blend(frame["tau_a"].to_numpy(dtype=float), o.shape + n / 2.0)
        tau_b = self.blend(frame["tau_b"].to_numpy(dtype=float), o.rate + rss / 2.0)
        ls_a, ls_b = frame["ls_a"].to_numpy(dtype=float), frame["ls_b"].to_numpy(dtype=float)
        if o.zero_inflated:
            ls_a, ls_b = o.a + n, o.b + self.full_n - n
        out = self.written(frame, ["test"])
        out["idle"], out["psi_a"], out["psi_b"] = list(idle), list(psi_a), list(psi_b)
        out["tau_a"], out["tau_b"], out["ls_a"], out["ls_b"] = tau_a, tau_b, ls_a, ls_b
        out["n"], out["rss"] = n, rss
        out["part"] = self.bound(
            m, m2, self.var, self.mu_v, self.s_v, second, logs, psi_a, psi_b, tau_a, tau_b, n, rss
        )
        return out

    def start(self, frame):
        """Starting coefficients from least squares, or from a random-intercept model."""
        o, p = self.o, self.o.width
        use = [j for j in range(p) if j != 1 or o.genotype_intercept]
        yy = frame["yy"].to_numpy(dtype=float)
        for i in range(len(frame)):
            gram, xy = self.gram[i], self.xy[i]
            if o.init == "mixed" and o.groups:
                classes = frame["classes"].iloc[i]
                model = OneGrouping.__new__(OneGrouping)
                model.n, model.m = (np.array([c[f] for c in classes], float) for f in ("n", "m"))
                model.levels = _full(np.array([c["outer"] for c in classes], float), p + 1)
                model.total = np.block([[gram, xy[:, None]], [xy[None, :], yy[i]]])
                model.rows = float((model.n * model.m).sum())
                theta, _ = _best_ratio(model, use, 1, True)
                beta = _profile(model, use, theta, True)[1]
            else:
                beta = np.linalg.pinv(gram[np.ix_(use, use)], rcond=1e-10, hermitian=True) @ xy[use]
            self.m[i, use] = beta
        self.m2[:] = self.m**2 + self.var
        self.mu_v[:] = self.m[:, o.v]

    def bound(self, m, m2, var, mu_v, s_v, second, logs, psi_a, psi_b, tau_a, tau_b, n, rss):
        """Terms of the evidence bound that belong to a test."""
        o = self.o
        total = np.zeros(len(m))
        if not o.tied_residual:
            mean_log = special.digamma(tau_a) - np.log(tau_b)
            total += -0.5 * n * np.log(2 * np.pi) + 0.5 * n * mean_log - 0.5 * tau_a / tau_b * rss
            total -= kl_gamma(o.shape, o.rate, tau_a, tau_b)
        total += 0.5 * np.log(var[:, 0])
        plain = [(1, o.gamma_f)] if o.genotype_intercept else []
        plain += [(2 + j, o.gamma_v) for j in range(o.n_c)]
        if o.environment_effect:
            plain += [(j, o.gamma_v) for j in range(o.d.start, o.d.stop)]
        if not o.factor_spike:
            plain += [(o.v.start + k, self.gamma_v[k]) for k in range(o.k)]
        for j, g in plain:
            total += 0.5 * (np.log(g) - g * m2[:, j] + np.log(var[:, j]) + 1.0)
        if o.factor_spike:
            ta, tb = self.theta_v
            for k in range(o.k):
                j, g = o.v.start + k, self.gamma_v[k]
                total += spike_bound(
                    mu_v[:, k], var[:, j], s_v[:, k], g,
                    special.digamma(ta[k]) - special.digamma(ta[k] + tb[k]),
                    special.digamma(tb[k]) - special.digamma(ta[k] + tb[k]),
                )
        for r in range(len(o.groups)):
            a, b = psi_a[:, r], psi_b[:, r]
            mean_log = special.digamma(a) - np.log(b)
            total += 0.5 * (self.sizes[r] * (mean_log + 1.0) - a / b * second[:, r] + logs[:, r])
            total -= kl_gamma(o.shape, o.rate, a, b)
        return total


def kl_gamma(shape0, rate0, shape, rate):
    """Divergence of a gamma posterior from its prior."""
    return (
        (shape - shape0) * special.digamma(shape) - special.gammaln(shape) + special.gammaln(shape0)
        + shape0 * (np.log(rate) - np.log(rate0)) + shape * (rate0 - rate) / rate
    )


def kl_beta(a0, b0, a, b):
    """Divergence of a beta posterior from its prior."""
    both = special.digamma(a + b)
    return (
        special.betaln(a0, b0) - special.betaln(a, b)
        + (a - a0) * (special.digamma(a) - both) + (b - b0) * (special.digamma(b) - both)
    )


def spike_bound(mu, var, s, precision, log_in, log_out):
    """Expected prior minus expected posterior log density of a spike-and-slab variable."""
    slab = 0.5 * (np.log(precision) - precision * (mu**2 + var) + np.log(var) + 1.0)
    inside = np.clip(s, 1e-300, 1.0)
    outside = np.clip(1 - s, 1e-300, 1.0)
    return s * slab + s * log_in + (1 - s) * log_out - s * np.log(inside) - (1 - s) * np.log(outside)


def _mean_of(o: Options, with_learned: bool) -> Column:
    """Part of the mean that does not come from the latents updated by sample."""
    mean = F.col("m")[0] + F.col("g") * F.col("m")[1]
    for r in range(len(o.groups)):
        mean = mean + F.col(f"_alpha{r}")
    for j in range(o.n_c if with_learned else o.n_covariates):
        mean = mean + F.col("c")[j] * F.col("m")[2 + j]
    return mean


def _effect(o: Options, k: int) -> tuple[Column, Column]:
    """Mean and second moment of the multiplier of loading k."""
    g, v = F.col("g"), o.v.start + k
    mean, second = g * F.col("m")[v], g * g * F.col("m2")[v]
    if o.environment_effect:
        d = o.d.start + k
        second = second + 2 * g * F.col("m")[v] * F.col("m")[d] + F.col("m2")[d]
        mean = mean + F.col("m")[d]
    return mean, second


def _all_joined(obs, fit: Fit, samples: DataFrame, tau) -> DataFrame:
    """Observations with the state of their sample, their test and their random intercepts."""
    o = fit.options
    groups = [f"_g{r}" for r in range(len(o.groups))]
    keep = ["sample", *(["c", "c2"] if o.n_c else []), "u", "u2", *groups]
    precision = F.lit(tau) if tau is not None else F.col("tau_a") / F.col("tau_b")
    params = fit.tests.select("test", "m", "m2", precision.alias("_tau"), "var")
    by_sample = broadcast_if_small(samples.select(*keep), width=2 * (o.k + o.n_c) + 4)
    joined = obs.join(by_sample, "sample").join(broadcast_if_small(params, width=3 * o.width + 8), "test")
    for r, g in enumerate(groups):
        own = fit.effects.where(F.col("r") == r).select(
            "test", F.col("z").alias(g), F.col("alpha").alias(f"_alpha{r}"), F.col("avar").alias(f"_avar{r}")
        )
        joined = joined.join(broadcast_if_small(own, width=4), ["test", g])
    return joined


def _sample_sums(obs, fit: Fit, samples: DataFrame, tau) -> DataFrame:
    """Cross products of each sample with the effects of its latents."""
    o, joined = fit.options, _all_joined(obs, fit, samples, tau)
    w = F.col("_tau") * (F.col("w") if o.zero_inflated else F.lit(1.0))
    rest = F.col("y") - _mean_of(o, False)
    effects = [_effect(o, k) for k in range(o.k)]
    for j in range(o.n_covariates, o.n_c):
        effects.append((F.col("m")[2 + j], F.col("m2")[2 + j]))
    cells = []
    for i, j in _triangle(len(effects)):
        cells.append(F.sum(w * (effects[i][1] if i == j else effects[i][0] * effects[j][0])))
    return joined.groupBy("sample").agg(
        F.array(*cells).alias("_a"),
        F.array(*[F.sum(w * e[0] * rest) for e in effects]).alias("_b"),
    )


class _SampleStep:
    """Coordinate updates of the loadings (and learned covariates) of a block of samples."""

    def __init__(self, o: Options, theta_a, theta_b, gamma_u):
        self.o, self.gamma_u = o, gamma_u
        self.log_odds = special.digamma(theta_a) - special.digamma(theta_b)

    def __call__(self, frames):
        o = self.o
        p = o.k + o.learn_covariates
        for frame in frames:
            seen = frame["_a"].notna()
            if not seen.all():  # samples without observations stay as they are
                yield frame[~seen].drop(columns=["_a", "_b"])
                frame = frame[seen].reset_index(drop=True)
            if not len(frame):
                continue
            a, b = _full(_stack(frame["_a"]), p), _stack(frame["_b"])
            mu, var, s = _stack(frame["mu"]), _stack(frame["uvar"]), _stack(frame["s"])
            c = _stack(frame["c"]) if o.n_c else np.zeros((len(frame), 0))
            c2 = _stack(frame["c2"]) if o.n_c else c
            now = np.column_stack([mu * s, c[:, o.n_covariates :]])
            if o.loading == "dirichlet":
                rest = b[:, : o.k] - np.einsum("bkl,bl->bk", a[:, : o.k, o.k :], now[:, o.k :])
                mu = simplex_map(a[:, : o.k, : o.k], rest, mu, o.dirichlet)
                s, var = np.ones_like(mu), np.zeros_like(mu)
                now[:, : o.k] = mu
            else:
                for k in range(o.k):
                    rest = b[:, k] - np.einsum("bl,bl->b", a[:, k], now) + a[:, k, k] * now[:, k]
                    if o.loading == "binary":
                        s[:, k] = special.sigmoid(self.log_odds[k] + rest - 0.5 * a[:, k, k])
                        now[:, k] = s[:, k]
                        continue
                    prec = a[:, k, k] + self.gamma_u[k]
                    var[:, k], mu[:, k] = 1.0 / prec, rest / prec
                    if o.loading == "spike":
                        odds = self.log_odds[k] + 0.5 * np.log(self.gamma_u[k] / prec) + rest**2 / (2 * prec)
                        s[:, k] = special.sigmoid(odds)
                    now[:, k] = mu[:, k] * s[:, k]
            for j in range(o.learn_covariates):
                i = o.k + j
                rest = b[:, i] - np.einsum("bl,bl->b", a[:, i], now) + a[:, i, i] * now[:, i]
                prec = np.maximum(a[:, i, i], 1e-12)
                now[:, i] = rest / prec
                c[:, o.n_covariates + j] = now[:, i]
                c2[:, o.n_covariates + j] = now[:, i] ** 2 + 1.0 / prec
            out = frame.drop(columns=["_a", "_b"]).copy()
            out["mu"], out["uvar"], out["s"] = list(mu), list(var), list(s)
            out["u"] = list(now[:, : o.k])
            second = s if o.loading == "binary" else s * (mu**2 + var)
            out["u2"] = list(second)
            if o.n_c:
                out["c"], out["c2"] = list(c), list(c2)
            yield out


def simplex_map(a, b, start, concentration, steps: int = 200):
    """Maximise b.u - u.a.u / 2 + (concentration - 1) sum(log u) on the simplex by
    exponentiated gradient with backtracking."""
    u = np.maximum(start, 1e-8)
    u = u / u.sum(1, keepdims=True)

    def value(x):
        fit = np.einsum("bk,bk->b", b, x) - 0.5 * np.einsum("bk,bkl,bl->b", x, a, x)
        return fit + (concentration - 1) * np.log(np.maximum(x, 1e-300)).sum(1)

    best = value(u)
    scale = np.abs(b).max(1) + np.abs(a).max((1, 2)) + abs(concentration - 1) + 1e-12
    rate = 1.0 / scale
    for _ in range(steps):
        grad = b - np.einsum("bkl,bl->bk", a, u) + (concentration - 1) / u
        move = rate[:, None] * grad
        move = np.clip(move - move.max(1, keepdims=True), -30, 0)
        trial = np.maximum(u * np.exp(move), 1e-12)
        trial = trial / trial.sum(1, keepdims=True)
        v = value(trial)
        up = v > best
        u = np.where(up[:, None], trial, u)
        gain = np.where(up, v - best, 0.0)
        best = np.where(up, v, best)
        rate = np.where(up, rate * 1.5, rate * 0.5)
        if gain.max(initial=0.0) < 1e-12 and (rate * scale).max(initial=0.0) < 1e-6:
            break
    return u


def _start_samples(samples: DataFrame, o: Options) -> tuple[DataFrame, list[int]]:
    """Starting loadings and integer codes of the random-effect groups."""
    out, sizes = samples, []
    for r, g in enumerate(o.groups):
        out = index_labels(out, g, out=f"_g{r}")
        sizes.append(samples.select(g).distinct().count())
    if o.init == "categories":
        coded = index_labels(out, o.init_category, out="_cat")
        hot = F.array(*[(F.col("_cat") == i).cast("double") for i in range(o.k)])
        out = coded.withColumn("mu", hot).drop("_cat")
    else:
        draws = _normal_draw(o.seed + 1, "sample", o.k)
        drawn = cut_lineage(out.withColumn("mu", F.array(*draws)))
        if o.loading in ("dirichlet",):
            weights = F.transform("mu", lambda x: F.exp(x))
            total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
            out = drawn.withColumn("mu", F.transform(weights, lambda x: x / total))
        else:
            moments = drawn.agg(
                *[F.avg(F.col("mu")[i]) for i in range(o.k)],
                *[F.stddev_pop(F.col("mu")[i]) for i in range(o.k)],
            ).head()
            fixed = [
                (F.col("mu")[i] - float(moments[i])) / float(moments[o.k + i] or 1.0) for i in range(o.k)
            ]
            out = drawn.withColumn("mu", F.array(*fixed))
    ones = F.array_repeat(F.lit(1.0), o.k)
    s = ones
    if o.loading == "binary":
        s = F.transform("mu", lambda x: 1 / (1 + F.exp(-x)))
        out = out.withColumn("_s", s).withColumn("mu", ones).withColumnRenamed("_s", "s")
    else:
        out = out.withColumn("s", s)
    spread = 0.0 if o.loading in ("binary", "dirichlet") else 1.0 / o.gamma_u
    out = out.withColumn("uvar", F.array_repeat(F.lit(spread), o.k))
    out = out.withColumn("u", F.zip_with("mu", "s", lambda a, b: a * b))
    second = F.zip_with("mu", "uvar", lambda a, v: a * a + v)
    out = out.withColumn("u2", F.col("s") if o.loading == "binary" else F.zip_with(second, "s", lambda x, y: x * y))
    if o.learn_covariates:
        extra = F.array(*_normal_draw(o.seed + 7, "sample", o.learn_covariates))
        out = out.withColumn("c", F.concat("c", extra) if o.n_covariates else extra)
    if o.n_c:
        out = out.withColumn("c", F.col("c").cast("array<double>"))
        out = out.withColumn("c2", F.transform("c", lambda x: x * x))
    keep = ["sample", *o.groups, *[f"_g{r}" for r in range(len(o.groups))], *(["c", "c2"] if o.n_c else [])]
    return cut_lineage(out.select(*keep, "mu", "uvar", "s", "u", "u2")), sizes


def _start_tests(obs: DataFrame, o: Options, sizes: Sequence[int]) -> DataFrame:
    slopes = obs.groupBy("test").agg(F.coalesce(F.regr_slope("y", "g"), F.lit(0.0)).alias("_f"))
    first = F.col("_f") if o.genotype_intercept else F.lit(0.0)
    zeros = [F.lit(0.0)] * o.n_c
    tail = [F.lit(0.0)] * o.k if o.environment_effect else []
    m = F.array(F.lit(0.0), first, *zeros, *_normal_draw(o.seed + 3, "test", o.k), *tail)
    out = slopes.withColumn("m", m)
    out = out.withColumn("var", F.array_repeat(F.lit(1.0), o.width))
    out = out.withColumn("m2", F.transform("m", lambda x: x * x + 1.0))
    prior = F.array_repeat(F.lit(o.shape), len(sizes)).cast("array<double>")
    idle = F.array_repeat(F.lit(1e-7), len(sizes)).cast("array<double>")
    return cut_lineage(
        out.select(
            "test", "m", "m2", "var",
            F.slice("m", o.v.start + 1, o.k).alias("mu_v"),
            F.array_repeat(F.lit(1.0), o.k).alias("s_v"),
            idle.alias("idle"),
            prior.alias("psi_a"), prior.alias("psi_b"),
            F.lit(o.shape).alias("tau_a"), F.lit(o.rate).alias("tau_b"),
            F.lit(10.0 * o.a).alias("ls_a"), F.lit(o.b).alias("ls_b"),
            F.lit(None).cast("double").alias("n"), F.lit(0.0).alias("rss"), F.lit(0.0).alias("part"),
        )
    )


def _structural_zeros(obs, fit: Fit, tau) -> DataFrame:
    """Probability that an entry follows the model; only exact zeros can be structural.

    The weights follow from the state of the fit and are made when they are read, not written.
    """
    o, tests = fit.options, fit.tests
    joined = _all_joined(obs, fit, fit.samples, tau)
    mean = _mean_of(o, True)
    spread = F.col("var")[0]
    if o.genotype_intercept:
        spread = spread + F.col("g") * F.col("g") * F.col("var")[1]
    for r in range(len(o.groups)):
        spread = spread + F.col(f"_avar{r}")
    for j in range(o.n_c):
        spread = spread + F.col("c2")[j] * F.col("m2")[2 + j] - (F.col("c")[j] * F.col("m")[2 + j]) ** 2
    for k in range(o.k):
        h, h2 = _effect(o, k)
        mean = mean + h * F.col("u")[k]
        spread = spread + h2 * F.col("u2")[k] - (h * F.col("u")[k]) ** 2
    error = (F.col("y") - mean) ** 2 + spread
    # the digamma difference of the beta posterior, one number per test
    odds = F.col("_odds") - 0.5 * F.col("_tau") * error - 0.5 * F.log(2 * np.pi / F.col("_tau"))
    weight = F.when(F.abs("y") < 1e-14, 1 / (1 + F.exp(-odds))).otherwise(1.0)

    def odds_of(frames):
        for frame in frames:
            out = frame[["test"]].copy()
            out["_odds"] = special.digamma(frame["ls_a"].to_numpy()) - special.digamma(
                frame["ls_b"].to_numpy()
            )
            yield out

    t = tests.schema["test"].dataType.simpleString()
    table = tests.select("test", "ls_a", "ls_b").mapInPandas(odds_of, f"test {t}, _odds double")
    weighed = joined.join(broadcast_if_small(table), "test")
    return weighed.select("test", "sample", "g", "y", weight.alias("w"))


def _sample_bound(samples: DataFrame, fit: Fit) -> float:
    """Terms of the evidence bound that belong to the samples."""
    o, total = fit.options, F.lit(0.0)
    for k in range(o.k):
        mu, var, s = F.col("mu")[k], F.col("uvar")[k], F.col("s")[k]
        g = float(fit.gamma_u[k])
        both = special.digamma(fit.theta_a[k] + fit.theta_b[k])
        log_in = float(special.digamma(fit.theta_a[k]) - both)
        log_out = float(special.digamma(fit.theta_b[k]) - both)
        slab = 0.5 * (float(np.log(g)) - g * (mu * mu + var) + F.log(var) + 1.0)
        if o.loading == "gaussian":
            total = total + slab
            continue
        if o.loading == "dirichlet":
            total = total + (o.dirichlet - 1) * F.log(mu)
            continue
        inside = s * F.log(F.greatest(s, F.lit(1e-300)))
        outside = (1 - s) * F.log(F.greatest(1 - s, F.lit(1e-300)))
        total = total + s * log_in + (1 - s) * log_out - inside - outside
        if o.loading == "spike":
            total = total + s * slab
    for j in range(o.n_covariates, o.n_c):
        total = total + 0.5 * F.log(F.col("c2")[j] - F.col("c")[j] * F.col("c")[j])
    return float(samples.agg(F.sum(total)).head()[0])


def elbo(fit: Fit, tau: tuple[float, float] | None = None) -> float:
    """Evidence lower bound of the current state, up to a constant."""
    o = fit.options
    row = fit.tests.agg(F.sum("part"), F.sum("n"), F.sum("rss")).head()
    value = row[0] + _sample_bound(fit.samples, fit)
    if tau is not None:
        a, b = tau
        mean_log = float(special.digamma(a)) - np.log(b)
        value += -0.5 * row[1] * np.log(2 * np.pi) + 0.5 * row[1] * mean_log - 0.5 * a / b * row[2]
        value -= float(kl_gamma(o.shape, o.rate, a, b))
    if o.loading in ("spike", "binary"):
        value -= float(np.sum(kl_beta(o.a, o.b, fit.theta_a, fit.theta_b)))
    if o.factor_spike:
        value -= float(np.sum(kl_beta(o.a, o.b, fit.theta_va, fit.theta_vb)))
    return float(value)


def _tests_moved(part, seen, fit: Fit, step: _TestStep, t_type: str) -> None:
    """New parameters of the tests and, between the halves of the step, of their intercepts."""
    o = fit.options
    if not o.groups:
        ready = fit.tests.join(_test_sums(part, seen, o), "test")
        fit.tests = cut_lineage(ready.mapInPandas(step.whole, _TEST_SCHEMA.format(t=t_type)))
        return
    p = o.width
    cells = cut_lineage(_design_sums(part, seen, o, ["test", *[f"_g{r}" for r in range(len(o.groups))]]))
    sums = cells.groupBy("test").agg(
        _sum_of("gram", p * (p + 1) // 2).alias("gram"), _sum_of("xy", p).alias("xy"), F.sum("yy").alias("yy")
    )
    levels = _levels(cells, fit.effects, o)
    ready = fit.tests.join(sums, "test").join(levels.groupBy("test").agg(_pulled(p).alias("pull")), "test")
    if step.first and o.init == "mixed":
        ready = ready.join(_size_moments(levels, p), "test")
    mid = cut_lineage(ready.mapInPandas(step.before_all, _MID_SCHEMA.format(t=t_type)))
    for r in range(len(o.groups)):
        moved = _new_effects(levels, mid, cells, o, r, step.step, step.tau)
        levels = moved if len(o.groups) == 1 else moved.unionByName(levels.where(F.col("r") != r))
    fit.effects = cut_lineage(levels.select("test", "r", "z", "alpha", "avar"))
    ready = mid.join(_effect_sums(levels, o), "test")
    fit.tests = cut_lineage(ready.mapInPandas(step.after_all, _TEST_SCHEMA.format(t=t_type)))


def eqtl_vi(
    obs: DataFrame,
    samples: DataFrame,
    k: int,
    *,
    iterations: int = 600,
    tolerance: float | None = None,
    track_elbo: bool = False,
    **choices,
) -> Fit:
    """Variational factorization. See ``Options`` for the model choices.

    Random intercepts are named by ``groups``; ``init_category`` names the label column of
    ``init="categories"``. With a ``tolerance`` the fit ends when a step changes the bound by
    less than that share of it, ``iterations`` at most; ``converged`` tells which came first.
    """
    o = Options(k=k, **{**choices, "groups": tuple(choices.get("groups", ()))})
    if len(o.groups) > 2:
        raise ValueError("at most two groupings")
    extra = [o.init_category] if o.init_category else []
    needed = ["sample", *o.groups, *extra, *(["c"] if o.n_covariates else [])]
    state, sizes = _start_samples(samples.select(*dict.fromkeys(needed)), o)
    columns = ["test", "sample", F.col("g").cast("double").alias("g"), F.col("y").cast("double").alias("y")]
    data, buckets = _by_sample(cut_lineage(obs.dropna(subset=["g", "y"]).select(*columns)))
    if buckets is not None:
        state = _kept(state, buckets, replaces=state, dealt=False)
    tests = _start_tests(data, o, sizes)
    t_type = data.schema["test"].dataType.simpleString()
    fit = Fit(
        state, tests, o, np.full(k, 10.0 * o.a), np.full(k, o.b), np.full(k, o.gamma_u), np.full(k, o.gamma_v)
    )
    if o.groups:
        fit.effects = _start_effects(data, state, o)
    if tolerance is not None:
        fit.converged = False
    if o.factor_spike:
        fit.theta_va, fit.theta_vb = np.full(k, 10.0 * o.a), np.full(k, o.b)
    n_samples, n_tests = state.count(), tests.count()
    tau = (o.shape, o.rate) if o.tied_residual else None
    rows = data.withColumn("w", F.lit(1.0)) if o.zero_inflated else data
    for it in range(iterations):
        rho, part, active = 1.0, rows, fit.samples
        if o.svi_fraction:
            rho = o.learning_rate / (1.0 + o.forgetting_rate * it) ** 0.75
            by = o.groups[0] if o.groups else "_all"
            pool = fit.samples if o.groups else fit.samples.withColumn("_all", F.lit(0))
            drawn = replicate_samples(
                pool, 1, o.svi_fraction, o.seed + it, cell="sample", individual=by
            ).select("sample")
            size = pool.groupBy(by).agg(F.count("*").alias("_n"))
            scale = F.col("_n") / F.ceil(F.col("_n") * F.lit(o.svi_fraction))
            drawn = pool.join(drawn, "sample", "left_semi")
            scales = broadcast_if_small(size.select(by, scale.alias("_scale")), width=2)
            active = _kept(drawn.join(scales, by), buckets, dealt=False)
            part = rows.join(broadcast_if_small(active.select("sample")), "sample", "left_semi")
        tau_value = None if tau is None else tau[0] / tau[1]
        # loadings
        base = active.drop("_scale", "_all")
        sums = _sample_sums(part, fit, base, tau_value)
        moved = base.join(sums, "sample", "inner" if o.svi_fraction else "left").select(*base.columns, "_a", "_b")
        schema = base.schema
        updated = _kept(
            moved.mapInPandas(_SampleStep(o, fit.theta_a, fit.theta_b, fit.gamma_u), schema), buckets
        )
        last, fit.samples = fit.samples, updated
        if o.svi_fraction:
            others = last.select(*base.columns).join(updated.select("sample"), "sample", "left_anti")
            fit.samples = _kept(updated.unionByName(others), buckets)
        # parameters of the tests
        seen = updated
        if o.svi_fraction:
            seen = updated.join(active.select("sample", "_scale"), "sample")
        theta_v = (fit.theta_va, fit.theta_vb) if o.factor_spike else None
        step = _TestStep(o, sizes, fit.gamma_v, theta_v, tau_value, rho, n_samples, it == 0)
        _tests_moved(part, seen, fit, step, t_type)
        discard(last)  # the weights of structural zeros came from it until now
        # global numbers, from column sums
        share = fit.samples if not o.svi_fraction else updated
        up = 1.0 / o.svi_fraction if o.svi_fraction else 1.0
        if it >= o.warmup and o.loading in ("spike", "binary"):
            totals = share.agg(F.count("*"), *[F.sum(F.col("s")[i]) for i in range(k)]).head()
            inside = up * np.array(totals[1:], dtype=float)
            outside = up * totals[0] - inside
            fit.theta_a = (1 - rho) * fit.theta_a + rho * (o.a + inside)
            fit.theta_b = (1 - rho) * fit.theta_b + rho * (o.b + outside)
        if it >= o.warmup and o.factor_spike:
            inside = np.array(
                fit.tests.agg(*[F.sum(F.col("s_v")[i]) for i in range(k)]).head(), dtype=float
            )
            fit.theta_va, fit.theta_vb = o.a + inside, o.b + n_tests - inside
        if o.ard in ("factors", "both"):
            sq = fit.tests.agg(*[F.sum(F.col("m2")[o.v.start + i]) for i in range(k)]).head()
            fit.gamma_v = (o.shape + n_tests / 2) / (o.rate + np.array(sq, dtype=float) / 2)
        if o.ard in ("loadings", "both"):
            empty = [(1 - F.col("s")[i]) / float(fit.gamma_u[i]) for i in range(k)]
            sq = share.agg(*[F.sum(F.col("u2")[i] + empty[i]) for i in range(k)]).head()
            fit.gamma_u = (o.shape + up * share.count() / 2) / (o.rate + up * np.array(sq, dtype=float) / 2)
        if o.tied_residual:
            row = fit.tests.agg(F.sum("n"), F.sum("rss")).head()
            new = (o.shape + row[0] / 2, o.rate + row[1] / 2)
            tau = tuple((1 - rho) * a + rho * b for a, b in zip(tau, new))
            fit.tests = fit.tests.withColumns({"tau_a": F.lit(tau[0]), "tau_b": F.lit(tau[1])})
        if o.zero_inflated:
            rows = _structural_zeros(data, fit, None if tau is None else tau[0] / tau[1])
        if o.svi_fraction:  # both are parts of the samples, written above
            discard(active)
            discard(updated)
        if track_elbo or tolerance is not None:
            fit.elbo.append(elbo(fit, tau))
        if tolerance is not None and it > o.warmup:
            last, now = fit.elbo[-2:]
            if abs(now - last) <= tolerance * abs(now):
                fit.converged = True
                break
    fit.obs = rows
    return fit


def prune_factors(fit: Fit, min_share: float = 0.025) -> Fit:
    """Drop factors of small expected inclusion from the state."""
    o = fit.options
    keep = [int(i) for i in np.where(fit.theta_a / (fit.theta_a + fit.theta_b) > min_share)[0]]
    new = replace(o, k=len(keep))

    def pick(column, start=0):
        return F.array(*[F.col(column)[start + i] for i in keep])

    samples = fit.samples.withColumns({c: pick(c) for c in ("mu", "uvar", "s", "u", "u2")})
    blocks = {}
    for c in ("m", "m2", "var"):
        parts = [F.slice(c, 1, 2 + o.n_c), pick(c, o.v.start)]
        if o.environment_effect:
            parts.append(pick(c, o.d.start))
        blocks[c] = F.concat(*parts)
    tests = fit.tests.withColumns({**blocks, "mu_v": pick("mu_v"), "s_v": pick("s_v")})
    return Fit(
        samples, tests, new, fit.theta_a[keep], fit.theta_b[keep], fit.gamma_u[keep], fit.gamma_v[keep],
        list(fit.elbo), fit.obs,
        None if fit.theta_va is None else fit.theta_va[keep],
        None if fit.theta_vb is None else fit.theta_vb[keep],
        fit.effects,
        fit.converged,
    )


def loadings(fit: Fit) -> DataFrame:
    """Expected loadings of the samples."""
    return fit.samples.select("sample", "u")


def intercepts(fit: Fit) -> DataFrame:
    """Random intercepts by test, grouping and level label, of levels with observations."""
    out = None
    for r, g in enumerate(fit.options.groups):
        labels = fit.samples.select(F.col(f"_g{r}").cast("long").alias("z"), F.col(g).cast("string").alias("level")).distinct()
        own = fit.effects.where(F.col("r") == r).join(broadcast_if_small(labels, width=8), "z")
        one = own.select("test", F.lit(g).alias("grouping"), "level", "alpha", F.col("avar").alias("variance"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the model has no random intercepts")
    return out


def factors(fit: Fit) -> DataFrame:
    """Parameters of the tests by name."""
    o = fit.options
    return fit.tests.select(
        "test",
        F.col("m")[0].alias("intercept"),
        F.col("m")[1].alias("f"),
        F.slice("m", o.v.start + 1, o.k).alias("v"),
        (F.col("tau_a") / F.col("tau_b")).alias("tau"),
    )


def eqtl_als(
    obs: DataFrame,
    samples: DataFrame,
    k: int,
    *,
    lambda_u: float = 1e-4,
    lambda_v: float = 1e-4,
    u: str = "lasso+",
    genotype_intercept: bool = True,
    weight_by_usage: bool = False,
    iterations: int = 100,
    tolerance: float | None = None,
    init_category: str | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Alternating least squares: ridge by test, lasso or simplex loadings by sample.

    Penalties count per observation. Returns loadings, test parameters and the mean squared
    residual by iteration. With a ``tolerance`` the fit ends when an iteration lowers that mean
    by less than this share of it; ``iterations`` entries tell that it has not settled.
    """
    if u not in ("lasso+", "lasso", "simplex"):
        raise ValueError(f"unknown loading rule {u}")
    o = Options(k=k, genotype_intercept=genotype_intercept, seed=seed)
    data, buckets = _by_sample(cut_lineage(obs.dropna(subset=["g", "y"]).select("test", "sample", "g", "y")))
    if init_category:
        coded = index_labels(samples.select("sample", init_category), init_category, out="_cat")
        start = F.array(*[(F.col("_cat") == i).cast("double") for i in range(k)])
    else:
        coded = samples.select("sample")
        uniform = [
            F.conv(F.substring(hash_order(seed * 31 + i, "sample"), 1, 8), 16, 10).cast("double") / 2.0**32
            for i in range(k)
        ]
        start = F.array(*uniform)
        if u == "simplex":
            total = F.aggregate(start, F.lit(0.0), lambda s, x: s + x)
            start = F.transform(start, lambda x: x / total)
    solved = state = _kept(coded.select("sample", start.alias("u")), buckets, dealt=False)
    use = [0, *([1] if genotype_intercept else []), *range(2, 2 + k)]
    types = {c: data.schema[c].dataType.simpleString() for c in ("test", "sample")}
    history = []
    for _ in range(iterations):
        with_square = state.withColumn("u2", F.transform("u", lambda x: x * x))
        usage = np.ones(k)
        if weight_by_usage:
            usage = np.array(state.agg(*[F.avg(F.col("u")[i]) for i in range(k)]).head(), dtype=float)
        penalty = np.zeros(2 + k)
        penalty[2:] = lambda_v * usage
        if weight_by_usage and not genotype_intercept:
            penalty[0] = 0.0

        def ridge(frames, penalty=penalty):
            for frame in frames:
                gram, xy = _full(_stack(frame["gram"]), 2 + k), _stack(frame["xy"])
                n = gram[:, 0, 0]
                full = gram[:, use][:, :, use] + n[:, None, None] * np.diag(penalty[use])
                beta = np.einsum(
                    "bij,bj->bi", np.linalg.pinv(full, rcond=1e-12, hermitian=True), xy[:, use]
                )
                m = np.zeros((len(frame), 2 + k))
                m[:, use] = beta
                out = frame[["test"]].copy()
                out["intercept"], out["f"], out["v"] = m[:, 0], m[:, 1], list(m[:, 2:])
                yield out

        tests = cut_lineage(
            _test_sums(data, with_square, o).mapInPandas(
                ridge, f"test {types['test']}, intercept double, f double, v array<double>"
            )
        )
        rest = F.col("y") - F.col("intercept") - F.col("g") * F.col("f")
        h = [F.col("g") * F.col("v")[i] for i in range(k)]
        sums = data.join(broadcast_if_small(tests), "test").groupBy("sample").agg(
            F.array(*[F.sum(h[i] * h[j]) for i, j in _triangle(k)]).alias("_a"),
            F.array(*[F.sum(h[i] * rest) for i in range(k)]).alias("_b"),
            F.sum(rest * rest).alias("_yy"),
            F.count("*").cast("double").alias("_n"),
        )

        def load(frames):
            for frame in frames:
                a, b = _full(_stack(frame["_a"]), k), _stack(frame["_b"])
                n, now = frame["_n"].to_numpy(), _stack(frame["u"])
                if u == "simplex":
                    now = simplex_project(a, b, now)
                else:
                    now = lasso(a, b, now, n * lambda_u, u == "lasso+")
                out = frame[["sample"]].copy()
                out["u"] = list(now)
                fit = np.einsum("bk,bkl,bl->b", now, a, now) - 2 * np.einsum("bk,bk->b", b, now)
                out["_rss"], out["_n"] = frame["_yy"].to_numpy() + fit, n
                yield out

        solved = _kept(
            state.join(sums, "sample").mapInPandas(
                load, f"sample {types['sample']}, u array<double>, _rss double, _n double"
            ),
            buckets,
            replaces=solved,
        )
        state = solved.select("sample", "u")
        row = solved.agg(F.sum("_rss"), F.sum("_n")).head()
        history.append(row[0] / row[1])
        if settled(history, tolerance):
            break
    return state, tests, history


def lasso(a, b, start, penalty, positive: bool, sweeps: int = 1000, tol: float = 1e-10):
    """Coordinate descent on u.a.u / 2 - b.u + penalty |u| for a block of samples."""
    u = start.copy()
    diag = np.einsum("bkk->bk", a)
    for _ in range(sweeps):
        before = u.copy()
        for k in range(u.shape[1]):
            rest = b[:, k] - np.einsum("bl,bl->b", a[:, k], u) + diag[:, k] * u[:, k]
            shrunk = np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0.0)
            if positive:
                shrunk = np.maximum(shrunk, 0.0)
            u[:, k] = np.where(diag[:, k] > 0, shrunk / np.where(diag[:, k] > 0, diag[:, k], 1.0), 0.0)
        if np.abs(u - before).max(initial=0.0) <= tol * (1 + np.abs(u).max(initial=0.0)):
            break
    return u


def simplex_project(a, b, start, steps: int = 500, tol: float = 1e-10):
    """Projected gradient for u.a.u / 2 - b.u on the probability simplex."""
    u = start.copy()
    size = np.maximum(np.linalg.norm(a, ord=2, axis=(1, 2)), 1e-12)[:, None]
    k = u.shape[1]
    for _ in range(steps):
        v = u - (np.einsum("bkl,bl->bk", a, u) - b) / size
        ordered = -np.sort(-v, axis=1)
        cum = (np.cumsum(ordered, axis=1) - 1) / np.arange(1, k + 1)
        count = (ordered > cum).sum(1)
        new = np.maximum(v - cum[np.arange(len(v)), count - 1][:, None], 0.0)
        moved = np.abs(new - u).max(initial=0.0)
        u = new
        if moved < tol:
            break
    return u


def eqtl_mixture(
    obs: DataFrame,
    k: int,
    *,
    iterations: int = 50,
    tolerance: float | None = None,
    intercept: bool = True,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Mixture of regressions: samples belong to one of k components, each with its own
    regression of y on g in every test. Returns posteriors by sample, regressions by test and
    the log-likelihood by iteration. With a ``tolerance`` the fit ends when an iteration changes
    that by less than this share of it."""
    data = cut_lineage(obs.dropna(subset=["g", "y"]).select("test", "sample", "g", "y"))
    raw = F.array(
        *[
            F.conv(F.substring(hash_order(seed * 17 + i, "sample"), 1, 8), 16, 10).cast("double") / 2.0**32 + 0.05
            for i in range(k)
        ]
    )
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    post = cut_lineage(data.select("sample").distinct().select("sample", F.transform(raw, lambda x: x / total).alias("p")))
    g, y = F.col("g"), F.col("y")
    history: list[float] = []
    for _ in range(iterations):
        prior = np.array(post.agg(*[F.avg(F.col("p")[i]) for i in range(k)]).head(), dtype=float)
        parts = []
        for i in range(k):
            w = F.col("p")[i]
            sw, sg, sy = F.sum(w), F.sum(w * g), F.sum(w * y)
            sgg, sgy, syy = F.sum(w * g * g), F.sum(w * g * y), F.sum(w * y * y)
            if intercept:
                cg = sgg - sg * sg / sw
                cy = sgy - sg * sy / sw
                slope = F.when(cg > 1e-12, cy / cg).otherwise(0.0)
                base = (sy - slope * sg) / sw
            else:
                slope = F.when(sgg > 1e-12, sgy / sgg).otherwise(0.0)
                base = F.lit(0.0)
            rss = (
                syy - 2 * base * sy - 2 * slope * sgy
                + base * base * sw + 2 * base * slope * sg + slope * slope * sgg
            )
            parts.append(
                F.struct(
                    base.alias("a"), slope.alias("b"),
                    F.greatest(rss / sw, F.lit(1e-8)).alias("s2"),
                )
            )
        models = cut_lineage(
            data.join(broadcast_if_small(post), "sample").groupBy("test").agg(F.array(*parts).alias("models"))
        )
        logs = []
        for i in range(k):
            c = F.col("models")[i]
            error = y - c["a"] - c["b"] * g
            logs.append(F.sum(-0.5 * F.log(2 * np.pi * c["s2"]) - error * error / (2 * c["s2"])))
        sums = data.join(broadcast_if_small(models), "test").groupBy("sample").agg(
            F.array(*[e + float(np.log(max(prior[i], 1e-300))) for i, e in enumerate(logs)]).alias("l")
        )
        top = F.array_max("l")
        scaled = F.transform("l", lambda x: F.exp(x - F.col("_top")))
        total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
        full = (
            sums.withColumn("_top", top)
            .withColumn("_e", scaled)
            .withColumn("_ll", F.col("_top") + F.log(total))
            .withColumn("p", F.transform("_e", lambda x: x / total))
        )
        full = cut_lineage(full.select("sample", "p", "_ll"))
        history.append(float(full.agg(F.sum("_ll")).head()[0]))
        post = full.select("sample", "p")
        if settled(history, tolerance):
            break
    return post, models, history
