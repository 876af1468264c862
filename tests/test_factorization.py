"""Factor models on small simulated tables: bounds rise and structure is recovered."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.operators import factorization as X

K = 2


def simulate(seed=0, n_ind=12, per=10, n_tests=40, zero=False):
    rng = np.random.default_rng(seed)
    n = n_ind * per
    z = np.repeat(np.arange(n_ind), per)
    u = rng.normal(size=(n, K)) * (rng.random((n, K)) < 0.6)
    v = rng.normal(size=(K, n_tests))
    f, mu = rng.normal(size=n_tests) * 0.5, rng.normal(size=n_tests)
    g = rng.integers(0, 3, size=(n_ind, n_tests))[z].astype(float)
    g = (g - g.mean(0)) / np.maximum(g.std(0), 0.1)
    a = rng.normal(size=(n_ind, n_tests)) * 0.3
    c = rng.normal(size=n)
    cw = rng.normal(size=n_tests) * 0.4
    y = mu + a[z] + np.outer(c, cw) + g * (f + u @ v) + rng.normal(size=(n, n_tests)) * 0.3
    if zero:
        y[rng.random(y.shape) < 0.1] = 0.0
    s, t = np.meshgrid(np.arange(n), np.arange(n_tests), indexing="ij")
    obs = pd.DataFrame(
        {"test": [f"t{i}" for i in t.ravel()], "sample": s.ravel(), "g": g.ravel(), "y": y.ravel()}
    )
    samples = pd.DataFrame(
        {"sample": np.arange(n), "donor": z, "plate": [f"p{i % 4}" for i in range(n)], "c": [[float(x)] for x in c]}
    )
    return obs, samples, u


@pytest.fixture(scope="module")
def data(spark):
    obs, samples, u = simulate()
    o = spark.createDataFrame(obs).persist()
    s = spark.createDataFrame(samples).persist()
    return o, s, u


def rises(values, slack=1e-6):
    steps = np.diff(values)
    return (steps >= -slack * np.abs(values[1:])).all()


def recovered(table, u, column="u"):
    """Smallest share of a true factor that the fitted ones explain."""
    rows = table.orderBy("sample").collect()
    est = np.column_stack([np.ones(len(rows)), np.array([r[column] for r in rows])])
    rest = u - est @ np.linalg.lstsq(est, u, rcond=None)[0]
    return (1 - rest.var(0) / u.var(0)).min()


def test_vi_with_groups_rises_and_recovers(data):
    obs, samples, u = data
    fit = X.eqtl_vi(obs, samples, K + 1, iterations=10, track_elbo=True, groups=["donor"])
    assert rises(fit.elbo)
    assert recovered(X.loadings(fit), u) > 0.85
    order = np.argsort(-(fit.theta_a / (fit.theta_a + fit.theta_b)))
    assert len(order) == K + 1
    pruned = X.prune_factors(fit, 0.3)
    assert pruned.options.k == int((fit.theta_a / (fit.theta_a + fit.theta_b) > 0.3).sum())
    assert len(pruned.tests.select("m").head()["m"]) == pruned.options.width


@pytest.mark.parametrize(
    "choices",
    [
        dict(n_covariates=1, groups=["donor", "plate"]),
        dict(factor_spike=True, environment_effect=True, n_covariates=1),
        dict(tied_residual=True, ard="both", loading="gaussian"),
        dict(loading="binary"),
        dict(loading="dirichlet"),
        dict(learn_covariates=1, groups=["donor"]),
        dict(init="regression", groups=["donor"]),
        dict(init="mixed", groups=["donor"], n_covariates=1),
        dict(init="categories", init_category="plate"),
        dict(genotype_intercept=False),
    ],
)
def test_vi_options_raise_the_bound(data, choices):
    obs, samples, _ = data
    fit = X.eqtl_vi(obs, samples, K, iterations=3, track_elbo=True, warmup=1, **choices)
    bound = fit.elbo
    if choices.get("ard"):
        # the bound holds precisions fixed; it is compared only for finiteness
        assert np.isfinite(bound).all()
    else:
        assert rises(bound)
    assert fit.samples.count() == samples.count()


def test_vi_matches_dense_updates(data):
    """One iteration against the same coordinate updates on dense arrays."""
    obs, samples, _ = data
    o = X.Options(k=K, groups=("donor",))
    start, sizes = X._start_samples(samples.select("sample", "donor"), o)
    tests0 = {r["test"]: r for r in X._start_tests(obs, o, sizes).collect()}
    rows = start.orderBy("sample").collect()
    frame = obs.toPandas()
    names = sorted(tests0)
    y = frame.pivot(index="sample", columns="test", values="y")[names].to_numpy()
    g = frame.pivot(index="sample", columns="test", values="g")[names].to_numpy()
    z = np.array([r["_g0"] for r in rows])
    mu, s = np.array([r["mu"] for r in rows]), np.ones((len(rows), K))
    f = np.array([tests0[t]["m"][1] for t in names])
    v = np.array([tests0[t]["m"][2:] for t in names])
    v2, tau = v**2 + 1.0, np.ones(len(names))
    icpt, alpha = np.zeros(len(names)), np.zeros((sizes[0], len(names)))
    lo = X.special.digamma(10.0) - X.special.digamma(1.0)
    uvar = np.ones_like(mu)
    for k in range(K):
        other = (mu * s) @ v.T - np.outer(mu[:, k] * s[:, k], v[:, k])
        a = (tau * g**2 * v2[:, k]).sum(1) + 1.0
        b = (tau * g * v[:, k] * (y - icpt - alpha[z] - g * (f + other))).sum(1)
        uvar[:, k], mu[:, k] = 1 / a, b / a
        s[:, k] = X.special.sigmoid(lo - 0.5 * np.log(a) + b**2 / (2 * a))
    u, u2 = mu * s, s * (mu**2 + uvar)
    vvar = np.ones_like(v)
    for k in range(K):
        other = v @ u.T - np.outer(v[:, k], u[:, k])
        a = 1.0 + tau * (g**2 * u2[:, [k]]).sum(0)
        b = tau * (g * u[:, [k]] * (y - alpha[z] - icpt - g * (other.T + f))).sum(0)
        vvar[:, k], v[:, k] = 1 / a, b / a
    pred = g * (f + u @ v.T)
    for i in range(sizes[0]):
        rest = (y - icpt - pred)[z == i]
        alpha[i] = tau * rest.sum(0) / (len(rest) * tau + 1.0)
    icpt = (y - alpha[z] - pred).mean(0)
    f = tau * (g * (y - alpha[z] - icpt - g * (u @ v.T))).sum(0) / (0.01 + tau * (g**2).sum(0))
    fit = X.eqtl_vi(obs, samples, K, iterations=1, groups=["donor"])
    got = {r["test"]: r for r in fit.tests.collect()}
    assert np.allclose([got[t]["m"][0] for t in names], icpt, atol=1e-9)
    assert np.allclose([got[t]["m"][1] for t in names], f, atol=1e-9)
    assert np.allclose([got[t]["m"][2:] for t in names], v, atol=1e-9)
    own = {(r["test"], r["z"]): r["alpha"] for r in fit.effects.collect()}
    assert np.allclose([[own[t, i] for t in names] for i in range(sizes[0])], alpha, atol=1e-9)
    us = np.array([r["u"] for r in fit.samples.orderBy("sample").collect()])
    assert np.allclose(us, u, atol=1e-9)


def test_vi_stochastic_and_zero_inflated(spark, data):
    obs, samples, u = data
    fit = X.eqtl_vi(obs, samples, K, iterations=6, svi_fraction=0.5, groups=["donor"], warmup=2)
    assert fit.samples.count() == samples.count()
    assert fit.tests.where(F.col("tau_b").isNull() | (F.col("tau_b") <= 0)).isEmpty()
    zo, zs, _ = simulate(3, zero=True)
    zfit = X.eqtl_vi(spark.createDataFrame(zo), spark.createDataFrame(zs), K, iterations=6, zero_inflated=True)
    w = zfit.obs.groupBy((F.col("y") == 0).alias("zero")).agg(F.avg("w").alias("w")).collect()
    by = {r["zero"]: r["w"] for r in w}
    assert by[False] == 1.0 and by[True] < 0.9


def test_weights_of_zeros_are_not_written(spark, monkeypatch):
    """The observations are written once, however many iterations weigh them."""
    obs, samples, _ = simulate(3, zero=True)
    table, n = spark.createDataFrame(obs), []
    kept, written = X._kept, X.cut_lineage
    count = lambda df: n.append("y" in df.columns)
    monkeypatch.setattr(X, "_kept", lambda df, *a, **k: count(df) or kept(df, *a, **k))
    monkeypatch.setattr(X, "cut_lineage", lambda df, **k: count(df) or written(df, **k))
    fit = X.eqtl_vi(table, spark.createDataFrame(samples), K, iterations=3, zero_inflated=True)
    assert sum(n) == 1
    assert fit.obs.columns == ["test", "sample", "g", "y", "w"]
    assert fit.obs.count() == len(obs)


@pytest.mark.parametrize("rule", ["lasso+", "lasso", "simplex"])
def test_als_lowers_the_error(data, rule):
    obs, samples, _ = data
    _, tests, history = X.eqtl_als(obs, samples, K, u=rule, iterations=5, weight_by_usage=rule == "simplex")
    assert history[-1] < history[0]
    assert all(b <= a * (1 + 1e-3) for a, b in zip(history, history[1:]))


def test_lasso_and_simplex_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    b = x.T @ (x @ np.array([0.2, 0.0, 0.8]))
    a = (x.T @ x)[None]
    assert np.allclose(X.simplex_project(a, b[None], np.full((1, 3), 1 / 3)), [[0.2, 0, 0.8]], atol=1e-6)
    sol = X.lasso(a, b[None], np.zeros((1, 3)), np.array([1.0]), True)[0]
    grad = a[0] @ sol - b
    assert np.allclose(grad[sol > 0], -1.0, atol=1e-6) and (grad[sol == 0] >= -1.0 - 1e-6).all()
    m = X.simplex_map(a, b[None], np.full((1, 3), 1 / 3), 1.0 + 1e-9)
    assert np.allclose(m, [[0.2, 0, 0.8]], atol=1e-3)


def test_mixture_separates_components(spark):
    rng = np.random.default_rng(5)
    n, t = 120, 30
    z = rng.integers(0, 2, n)
    slope = rng.normal(size=(2, t)) * 2
    g = rng.normal(size=(n, t))
    y = g * slope[z] + rng.normal(size=(n, t)) * 0.5
    s, k = np.meshgrid(np.arange(n), np.arange(t), indexing="ij")
    obs = spark.createDataFrame(
        pd.DataFrame({"test": k.ravel(), "sample": s.ravel(), "g": g.ravel(), "y": y.ravel()})
    )
    post, _, history = X.eqtl_mixture(obs, 2, iterations=12)
    p = np.array([r["p"] for r in post.orderBy("sample").collect()])
    agree = (p.argmax(1) == z).mean()
    assert max(agree, 1 - agree) > 0.97
    assert rises(history)


def test_steps_do_not_shuffle_the_observations_by_sample(spark):
    """Sums by sample and joins with the samples stay in the buckets; a large sample is not bucketed."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select((F.col("id") % 4000).alias("sample"), (F.col("id") % 15).alias("test"), F.rand(1).alias("y"))
    data, n = X._by_sample(X.cut_lineage(rows))
    state = X._kept(rows.select("sample").distinct().withColumn("u", F.lit(1.0)), n, dealt=False)
    joined = data.join(state.hint("merge"), "sample").groupBy("sample").agg(F.sum(F.col("y") * F.col("u")).alias("s"))
    assert n > 1 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 4000
    hot, none = X._by_sample(X.cut_lineage(rows.withColumn("sample", F.lit(1))))
    assert none is None and hot.count() == 60_000
