"""Per-test models against dense numpy computations."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.operators import count_models as C
from varloom.operators import mixed as X
from varloom.operators import regression as M


def table(seed=0, n_tests=3, n_groups=8, per=(3, 12)):
    rng = np.random.default_rng(seed)
    out = []
    for t in range(n_tests):
        for g in range(n_groups):
            n = rng.integers(*per)
            x = rng.integers(0, 3) + 0.2 * rng.normal(size=n)
            c = rng.normal(size=n)
            y = 0.5 * x + 0.3 * c + rng.normal() * 0.8 + rng.normal(size=n) * (0.4 + 0.2 * t)
            out.append(pd.DataFrame({"test": f"t{t}", "individual_id": g, "plate_id": rng.integers(0, 3, n), "x": x, "c": c, "y": y}))
    frame = pd.concat(out, ignore_index=True)
    frame["cell_id"] = np.arange(len(frame))
    frame["pseudotime"] = rng.random(len(frame))
    return frame


@pytest.fixture(scope="module")
def frame():
    return table()


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).persist()


def by_test(result):
    return {r["test"]: r for r in result.collect()}


def test_ols(df, frame):
    got = by_test(M.grouped_ols(df, ["test"], covariates=["c"]))
    resid = by_test(M.grouped_ols_residual(df, ["test"], covariates=["c"]))
    for t, f in frame.groupby("test"):
        a = np.column_stack([np.ones(len(f)), f.x, f.c])
        b, rss, *_ = np.linalg.lstsq(a, f.y, rcond=None)
        n, s2 = len(f), rss[0] / (len(f) - 3)
        se = np.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1])
        null = np.linalg.lstsq(a[:, [0, 2]], f.y, rcond=None)[1][0]
        ll = [-0.5 * n * (np.log(2 * np.pi * v / n) + 1) for v in (rss[0], null)]
        r = got[t]
        assert np.allclose([r["beta"], r["standard_error"], r["residual_scale"]], [b[1], se, s2])
        assert np.isclose(r["pvalue"], special.student_t_two_sided(b[1] / se, n - 3), rtol=1e-8)
        assert np.isclose(r["pseudo_r2"], 1 - ll[0] / ll[1])
        assert np.isclose(resid[t]["beta"], b[1])
        assert np.isclose(resid[t]["standard_error"], se * np.sqrt((n - 3) / (n - 1)))


def test_ols_without_variation_is_null(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 5.0)], ["test", "x", "y"])
    r = M.grouped_ols(d, ["test"]).head()
    assert r["beta"] is None and r["pvalue"] is None


def test_cell_type_effects(df, frame):
    got = by_test(M.cell_type_effects(df, ["test"], [0, 1, 2], category="plate_id"))
    for t, f in frame.groupby("test"):
        a = np.column_stack([f.x, *[f.x * (f.plate_id == k) for k in range(3)]])
        b = np.linalg.pinv(a - a.mean(0)) @ (f.y - f.y.mean())
        assert np.allclose([got[t]["f"], *got[t]["v"]], b)


def dense_deviance(f, columns, groups, theta, reml):
    a = np.column_stack([np.ones(len(f)), *[f[c] for c in columns]])
    v = np.eye(len(f))
    for g, r in zip(groups, theta):
        z = pd.get_dummies(f[g]).to_numpy(dtype=float)
        v += r * z @ z.T
    w = np.linalg.inv(v)
    xx = a.T @ w @ a
    b = np.linalg.solve(xx, a.T @ w @ f.y.to_numpy())
    e = f.y.to_numpy() - a @ b
    left = len(f) - (a.shape[1] if reml else 0)
    s2 = e @ w @ e / left
    dev = left * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1]
    if reml:
        dev += np.linalg.slogdet(xx)[1]
    return dev, b, np.sqrt(s2 * np.diag(np.linalg.inv(xx))), s2


def test_lmm_is_the_reml_optimum(df, frame):
    got = by_test(X.grouped_lmm(df, ["test"], covariates=["c"]))
    for t, f in frame.groupby("test"):
        grid = np.linspace(0, 12, 4001)
        devs = [dense_deviance(f, ["x", "c"], ["individual_id"], [r], True)[0] for r in grid[::40]]
        r = got[t]
        dev, b, se, s2 = dense_deviance(f, ["x", "c"], ["individual_id"], [r["theta"]], True)
        assert dev <= min(devs) + 1e-9
        assert np.allclose([r["beta"], r["standard_error"]], [b[1], se[1]], rtol=1e-7)
        assert np.isclose(r["re_sd"] ** 2, r["theta"] * s2, rtol=1e-6)
        assert 3 < r["df"] <= len(f) and 0 <= r["pvalue"] <= 1


@pytest.mark.parametrize("groups", [["individual_id"], ["individual_id", "plate_id"]])
def test_lrt_matches_dense_deviances(df, frame, groups):
    got = by_test(X.eqtl_lrt(df, ["test"], covariates=["c"], groups=groups))
    for t, f in frame.groupby("test"):
        grid = [0.0, *np.logspace(-3, 1.5, 200 if len(groups) == 1 else 30)]
        best = [
            min(dense_deviance(f, cols, groups, th, False)[0] for th in itertools.product(grid, repeat=len(groups)))
            for cols in (["c"], ["c", "x"])
        ]
        assert abs(got[t]["lr"] - (best[0] - best[1])) < 0.05
        assert np.isclose(got[t]["pvalue"], special.chi2_tail(got[t]["lr"], 1))


def dense_weighted(frame, groups, columns, theta):
    """Cross products in the metric of the inverse covariance, by the whole covariance matrix."""
    v = np.column_stack([np.ones(len(frame)), frame[columns]])
    cov = np.eye(len(frame))
    for g, t in zip(groups, theta):
        z = pd.get_dummies(frame[g]).to_numpy(float)
        cov += t * z @ z.T
    return v.T @ np.linalg.solve(cov, v), np.linalg.slogdet(cov)[1]


@pytest.mark.parametrize("groups", [["a", "b"], ["b", "a"], ["a", "b", "ab"], ["a", "b", "c"]])
def test_crossed_elimination_equals_the_dense_solution(groups):
    rng = np.random.default_rng(4)
    n = 400
    f = pd.DataFrame({"a": rng.integers(0, 60, n), "b": rng.integers(0, 7, n), "c": rng.integers(0, 25, n)})
    f["ab"] = f.a.astype(str) + "_" + f.b.astype(str)
    f["x"], f["y"] = rng.normal(size=n), rng.normal(size=n)
    cells = f.assign(xx=f.x * f.x, xy=f.x * f.y, yy=f.y * f.y, n=1.0).groupby(groups, as_index=False)[
        ["n", "x", "y", "xx", "xy", "yy"]
    ].sum()
    cells["s"], cells["ss"] = list(cells[["x", "y"]].to_numpy()), list(cells[["xx", "xy", "yy"]].to_numpy())
    model = X.CrossedGroupings(cells, groups)
    for theta in ([0.0] * len(groups), [0.3, 2.0, 0.7][: len(groups)], [5.0, 0.0, 0.01][: len(groups)]):
        got, logdet = model.weighted(theta)
        want, dense = dense_weighted(f, groups, ["x", "y"], theta)
        assert np.allclose(got, want, rtol=1e-8) and np.isclose(logdet, dense, rtol=1e-8, atol=1e-8)


def test_lrt_of_ten_thousand_donors(spark):
    """One test with crossed donors and plates, and with donors within plates too."""
    rng = np.random.default_rng(6)
    n, donors = 30_000, 10_000
    d, p = rng.integers(0, donors, n), rng.integers(0, 20, n)
    f = pd.DataFrame({"test": "t", "individual_id": d, "plate_id": p, "x": rng.integers(0, 3, donors)[d].astype(float)})
    f["pseudotime"], f["c"] = rng.random(n), rng.normal(size=n)
    f["y"] = (
        0.3 * f.x + 0.25 * f.x * f.pseudotime + rng.normal(size=donors)[d] * 0.7
        + rng.normal(size=20)[p] * 0.5 + rng.normal(size=n)
    )
    rows = spark.createDataFrame(f)
    groups = ["individual_id", "plate_id"]
    r = X.dynamic_lrt(rows, ["test"], covariates=["c"], groups=groups).head()
    assert abs(r["effects"][0] - 0.25) < 0.1 and r["pvalue"] < 1e-4
    assert abs(r["re_sd"][0] - 0.7) < 0.05 and abs(r["re_sd"][1] - 0.5) < 0.3
    m = X.modulated_lrt(rows, ["test"], covariates=["pseudotime"]).head()
    assert abs(m["re_sd"][0] - 0.7) < 0.05 and m["re_sd"][2] < 0.2 and m["pvalue"] < 1e-4


def test_dynamic_and_modulated(df):
    d = X.dynamic_lrt(df, ["test"], covariates=["c"], groups=["individual_id"], quadratic=True)
    assert all(len(r["effects"]) == 2 and 0 <= r["pvalue"] <= 1 for r in d.collect())
    m = X.modulated_lrt(df, ["test"], covariates=["c", "pseudotime"])
    assert all(len(r["re_sd"]) == 3 and len(r["effects"]) == 2 for r in m.collect())


def test_het(df, frame):
    fits = by_test(X.grouped_lmm(df, ["test"], covariates=["c"]))
    got = by_test(X.het_test(df, ["test"], covariates=["c"]))
    for t, f in frame.groupby("test"):
        r = fits[t]
        e = f.y - np.column_stack([np.ones(len(f)), f.x, f.c]) @ np.array(r["coefficients"])
        u = e.groupby(f.individual_id).transform(lambda v: r["theta"] / (1 + len(v) * r["theta"]) * v.sum())
        r2 = np.corrcoef((e - u) ** 2, f.x)[0, 1] ** 2
        n = len(f)
        assert np.isclose(got[t]["het_pvalue"], special.chi2_tail(n * r2, 1), rtol=1e-6)
        assert np.isclose(got[t]["het_f_pvalue"], special.f_tail(r2 / (1 - r2) * (n - 2), 1, n - 2), rtol=1e-6)


def test_negbin_gradient_vanishes(spark):
    rng = np.random.default_rng(2)
    n = 400
    f = pd.DataFrame({"test": ["a", "b"] * (n // 2), "x": rng.integers(0, 3, n), "c": rng.normal(size=n)})
    f["library_size"] = rng.integers(500, 3000, n)
    mu = f.library_size / 1000 * np.exp(0.3 + 0.4 * f.x - 0.2 * f.c)
    f["y"] = rng.poisson(mu * rng.gamma(2.0, 0.5, n))
    got = by_test(C.grouped_negbin(spark.createDataFrame(f), ["test"], covariates=["c"]))
    for t, g in f.groupby("test"):
        r = got[t]
        assert abs(r["beta"] - 0.4) < 4 * r["standard_error"]
        assert 0 < r["pvalue"] < 0.05 and 0 < r["pseudo_r2"] < 1
        # the optimum is no worse than its neighbours in x and in the dispersion
        rows = pd.DataFrame({"_x": [[1.0, a, b] for a, b in zip(g.x, g.c)], "_y": g.y.astype(float), "_offset": np.log(g.library_size)})

        def ll(theta):
            return C.negbin_terms(rows, np.tile(theta, (len(rows), 1)))[0].sum()

        best = np.array([0.3 - np.log(1000), r["beta"], -0.2, np.log(r["dispersion"])])
        for _ in range(30):
            v, gr, h = C.negbin_terms(rows, np.tile(best, (len(rows), 1)))
            best = best - np.linalg.solve(h.sum(0), gr.sum(0))
        assert np.isclose(ll(best), r["ll"]) and np.isclose(best[1], r["beta"], atol=1e-5)
        assert np.isclose(np.sqrt(np.linalg.inv(-h.sum(0))[1, 1]), r["standard_error"], rtol=1e-4)


def numeric_check(fn, theta):
    value, grad, hess = fn(theta)
    h = 1e-5
    for j in range(theta.shape[1]):
        up, down = theta.copy(), theta.copy()
        up[:, j] += h
        down[:, j] -= h
        assert np.allclose((fn(up)[0] - fn(down)[0]) / (2 * h), grad[:, j], atol=1e-4, rtol=1e-4)
        assert np.allclose((fn(up)[1] - fn(down)[1]) / (2 * h), hess[:, j], atol=1e-3, rtol=1e-3)


def test_row_terms_match_numeric_derivatives():
    rng = np.random.default_rng(4)
    n = rng.integers(3, 20, 6).astype(float)
    y = np.floor(rng.random(6) * n)
    rows = pd.DataFrame({"_y": y, "_n": n, "_w": 1.0 + rng.random(6)})
    for family, p in (("folded_binomial", 1), ("beta_binomial", 2), ("folded_beta_binomial", 2)):
        numeric_check(lambda th: C._allelic_terms(family)(rows, th), rng.normal(size=(6, p)))
    nb = pd.DataFrame({"_x": [[1.0, v] for v in rng.normal(size=6)], "_y": y, "_offset": rng.normal(size=6)})
    numeric_check(lambda th: C.negbin_terms(nb, th), rng.normal(size=(6, 3)))
    from varloom.operators import ase_factorization as A

    full = rows.assign(_x=[[1.0, v] for v in rng.normal(size=6)], _w1=rng.random(6), _w2=rng.random(6), _conc=5.0, _offset=0.3)
    numeric_check(lambda th: A._site_terms("beta_binomial", False, True)(full, th), rng.normal(size=(6, 3)))
    numeric_check(lambda th: A._site_terms("beta_binomial", True, False)(full, th), rng.normal(size=(6, 2)))
    numeric_check(lambda th: A._cell_terms("folded_binomial", False)(full, th), rng.normal(size=(6, 2)))
    numeric_check(lambda th: A._skew_terms("_w1", True)(full, th), rng.normal(size=(6, 1)))


@pytest.mark.parametrize("family", ["binomial", "folded_binomial", "beta_binomial", "folded_beta_binomial"])
def test_allelic_mean_against_a_grid(spark, family):
    rng = np.random.default_rng(6)
    n = rng.integers(2, 30, 300)
    p = np.where(rng.random(300) < 0.5, 0.3, 0.7)
    f = pd.DataFrame({"site_id": rng.integers(0, 2, 300), "allele_count": rng.binomial(n, p), "total_count": n})
    got = {r["site_id"]: r for r in C.grouped_allelic_mean(spark.createDataFrame(f), ["site_id"], family=family).collect()}
    for s, g in f.groupby("site_id"):
        y, m = np.minimum(g.allele_count, g.total_count - g.allele_count).to_numpy(), g.total_count.to_numpy()
        if family == "binomial":
            assert np.isclose(got[s]["mean"], y.sum() / m.sum())
            continue
        rows = pd.DataFrame({"_y": y, "_n": m, "_w": 1.0})
        logit = np.linspace(-3, 0, 121)
        lams = np.linspace(0, 9, 46) if "beta" in family else [None]

        def value(e, lam):
            theta = np.tile([e] if lam is None else [e, lam], (len(rows), 1)).astype(float)
            out = C._allelic_terms(family)(rows, theta)[0].sum()
            return out if lam is None else out + 1e-4 * lam - 1e-4 * np.exp(lam)

        best = max(value(e, lam) for e in logit for lam in lams)
        assert got[s]["ll"] >= best - 1e-6
        assert 0 < got[s]["mean"] <= 0.5


def test_bootstrap_takes_ceil_of_each_donor(spark, df, frame):
    cells = df.select("cell_id", "individual_id")
    r = M.replicate_samples(cells, 3, 0.4, 5)
    sizes = frame.groupby("individual_id").size()
    got = r.groupBy("replicate", "individual_id").agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("d"))
    for row in got.collect():
        assert row["n"] == row["d"] == int(np.ceil(sizes[row["individual_id"]] * 0.4))
    lmm = M.bootstrap_stability(
        df, cells, ["test"], 2, 0.7, 1, covariates=["c"],
        fit=lambda rows, keys: X.grouped_lmm(rows, keys, covariates=["c"]),
    )
    assert lmm.count() == 6
    resid = M.bootstrap_stability(df, cells, ["test"], 2, 0.7, 1, covariates=["c"], residualize=True)
    assert resid.dropna().count() == 6


def test_drawn_cells_have_the_smallest_hashes(spark, monkeypatch):
    """The draw is that of a sort by hash, and it sorts no more than the cells at its edge."""
    rows = [(c, None if c % 11 == 0 else c % 3) for c in range(400)] + [(7, 1)] * 3 + [(500, 9)]
    cells = spark.createDataFrame(rows, "cell_id int, individual_id int")
    monkeypatch.setattr(M, "ranked", None)
    monkeypatch.setattr(M, "_DIGITS", 1)  # many cells at the edge
    for fraction in (0.0, 0.3, 1.0, 1.5):
        got = sorted(tuple(r) for r in M.replicate_samples(cells, 2, fraction, 5).collect())
        want = []
        for r in range(2):
            key = lambda c: (hashlib.md5(f"5|{r}|{c}".encode()).hexdigest(), c)
            for donor in (0, 1, 2, 9):
                own = sorted((c for c, i in rows if i == donor), key=key)
                want += [(r, c, donor) for c in own[: math.ceil(len(own) * fraction)]]
        assert got == sorted(want)


def test_permutation_moves_whole_donors(spark):
    g = spark.createDataFrame([(v, i, float((v * 7 + i * 3) % 5)) for v in range(4) for i in range(9)], ["variant_id", "individual_id", "dosage"])
    before = {i: sorted((r["variant_id"], r["dosage"]) for r in g.where(F.col("individual_id") == i).collect()) for i in range(9)}
    p = M.permute_by_group(g, 3)
    after = {i: sorted((r["variant_id"], r["dosage"]) for r in p.where(F.col("individual_id") == i).collect()) for i in range(9)}
    assert sorted(map(str, before.values())) == sorted(map(str, after.values()))
    assert before != after


def test_crossed_levels_reach_the_worker_as_plain_numbers(spark, monkeypatch):
    """No array for every level; the fit is that of the arrays."""
    rng = np.random.default_rng(21)
    n = 200
    f = pd.DataFrame({"test": "t", "a": rng.integers(0, 20, n), "b": rng.integers(0, 4, n), "x": rng.normal(size=n)})
    f["y"] = f.x + rng.normal(size=20)[f.a] + rng.normal(size=n)
    seen = []
    class Grouped(type(spark.range(1).groupBy("id"))):
        pass
    apply = Grouped.__mro__[1].applyInPandas
    monkeypatch.setattr(Grouped.__mro__[1], "applyInPandas", lambda self, fn, schema: seen.append(self._df) or apply(self, fn, schema))
    got = X.eqtl_lrt(spark.createDataFrame(f), ["test"], groups=["a", "b"]).head()
    assert got.n == n and np.isfinite(got.lr)
    assert not any(t.startswith("array") for _, t in seen[0].dtypes)
