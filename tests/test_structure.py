"""Rankings, neighbours, selections, decompositions and allelic fits against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.operators import ase_factorization as A
from varloom.operators import decomposition as D
from varloom.operators import neighbors as K
from varloom.operators import selection as S
from varloom.plans.scale import ranked, tie_ranks


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most of the rows, and a value tied over a third of them."""
    rng = np.random.default_rng(0)
    n = 3000
    f = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n)), "id": np.arange(n)})
    f["v"] = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 2))
    return f, spark.createDataFrame(f).repartition(7).persist()


def test_ranked(skewed):
    f, df = skewed
    got = ranked(df, ["v", "id"]).toPandas().set_index("id")["rank"]
    want = f.sort_values(["v", "id"]).reset_index(drop=True).reset_index().set_index("id")["index"] + 1
    assert (got.sort_index() == want.sort_index()).all()
    got = ranked(df, [F.col("v").desc(), "id"], by=["k"]).toPandas().set_index("id")["rank"]
    s = f.sort_values(["v", "id"], ascending=[False, True])
    want = pd.Series(s.groupby("k").cumcount().to_numpy() + 1, index=s["id"])
    assert (got.sort_index() == want.sort_index()).all()


def test_tie_ranks(skewed):
    f, df = skewed
    got = tie_ranks(df, "v", by=["k"]).toPandas().set_index(["k", "v"])
    low = f.groupby("k")["v"].rank(method="min")
    high = f.groupby("k")["v"].rank(method="max")
    want = f.assign(lo=low, hi=high).drop_duplicates(["k", "v"]).set_index(["k", "v"])
    assert (got["lo"].sort_index() == want["lo"].sort_index()).all()
    assert (got["hi"].sort_index() == want["hi"].sort_index()).all()
    assert K.median_of(df, "v") == np.median(f["v"])


@pytest.mark.parametrize("metric", ["euclidean", "pearson"])
def test_knn_is_exact_with_a_hot_group(spark, metric):
    rng = np.random.default_rng(1)
    n, d, k = 400, 6, 5
    x = rng.normal(size=(n, d)) * np.array([4, 3, 2, 1, 1, 1])
    x[:20] = x[20:40]  # exact duplicates tie at distance zero
    group = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    df = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "individual_id": group, "pcs": x.tolist()}))
    got = K.knn(df, k, metric=metric, block_size=24).toPandas()
    if metric == "euclidean":
        z = (x - x.mean(0)) / x.std(0)
    else:
        z = x - x.mean(1, keepdims=True)
        z = z / np.linalg.norm(z, axis=1, keepdims=True)
    for i in range(n):
        same = np.where((group == group[i]) & (np.arange(n) != i))[0]
        dist = np.sqrt(((z[same] - z[i]) ** 2).sum(1))
        mine = got[got["cell_id"] == i].sort_values("rank")
        assert len(mine) == min(k, len(same))
        assert np.allclose(mine["distance"], np.sort(dist)[:k], atol=1e-7)
    assert not (got["cell_id"] == got["neighbor_id"]).any()


def test_ld_prune_equals_the_one_by_one_scan(spark):
    rng = np.random.default_rng(2)
    n_var, n_ind = 60, 40
    base = rng.integers(0, 3, (12, n_ind))
    g = base[rng.integers(0, 12, n_var)] + (rng.random((n_var, n_ind)) < 0.15)
    pairs = pd.DataFrame([("a", v) for v in range(n_var)] + [("b", v) for v in range(0, n_var, 3)], columns=["gene_id", "variant_id"])
    i, j = np.meshgrid(np.arange(n_var), np.arange(n_ind), indexing="ij")
    gt = pd.DataFrame({"variant_id": i.ravel(), "individual_id": j.ravel(), "dosage": g.ravel().astype(float)})
    got = S.ld_prune(spark.createDataFrame(pairs), spark.createDataFrame(gt), 0.3, 9, batch=7)
    got = {(r["gene_id"], r["variant_id"]) for r in got.collect()}
    want = set()
    for gene, f in pairs.groupby("gene_id"):
        kept = []
        for v in sorted(f.variant_id, key=lambda v: (md5(9, gene, v), v)):
            if all(np.corrcoef(g[v], g[w])[0, 1] ** 2 < 0.3 for w in kept):
                kept.append(v)
        want |= {(gene, v) for v in kept}
    assert got == want


def test_greedy_selection_equals_the_one_by_one_scan(spark):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"gene_id": rng.integers(0, 30, 300), "variant_id": rng.integers(0, 25, 300)}).drop_duplicates()
    f["pvalue"] = rng.random(len(f))
    f["cell_type"] = rng.choice(["x", "y"], len(f))
    got = {(r["gene_id"], r["variant_id"]) for r in S.dedupe_tests(spark.createDataFrame(f), ["pvalue"]).collect()}

    def scan(rows):
        genes, variants, out = set(), set(), []
        for r in rows:
            if r.gene_id not in genes and r.variant_id not in variants:
                genes.add(r.gene_id)
                variants.add(r.variant_id)
                out.append((r.gene_id, r.variant_id))
        return out

    want = scan(f.sort_values("pvalue").itertuples())
    assert got == set(want)
    capped = S.dedupe_tests(spark.createDataFrame(f), ["pvalue"], 5)
    assert {(r["gene_id"], r["variant_id"]) for r in capped.collect()} == set(want[:5])
    drawn = S.sample_tests(spark.createDataFrame(f), 20, "cell_type", 1, by_order=["y", "x"])
    f["h"] = [md5(1, r.cell_type, r.gene_id, r.variant_id) for r in f.itertuples()]
    order = pd.concat([f[f.cell_type == c].sort_values("h").head(20) for c in ("y", "x")])
    assert {(r["gene_id"], r["variant_id"]) for r in drawn.collect()} == set(scan(order.itertuples()))


def test_order_factors():
    assert S.order_factors([1.0, 9.0, 0.01], [9.0, 1.0, 9.99]) == [1, 0]


def matrix(spark, x, feature="gene_id", sample="cell_id"):
    i, j = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({feature: [f"g{a:02d}" for a in i], sample: j, "value": x[i, j]}))


def test_pca_of_pearson_residuals_counts_zeros(spark):
    from varloom.operators.normalize import pearson_residuals, pearson_zero_terms

    rng = np.random.default_rng(3)
    x = rng.poisson(rng.gamma(1.0, 1.0, size=(60, 1)) * rng.gamma(0.6, 1.0, size=(1, 35)))
    x[:, 0] += 1
    x[0] += 1
    n, p = x.sum(1, keepdims=True), x.sum(0, keepdims=True) / x.sum()
    res = (x - n * p) / np.sqrt(n * p * (1 - p))
    res = (res - res.mean(0)) / res.std(0)
    u, s, _ = np.linalg.svd(res, full_matrices=False)
    i, j = np.nonzero(x)
    counts = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "count": x[i, j].astype(float)}))
    entries, table = pearson_residuals(counts)
    scores, explained = D.pca(entries, 4, zeros=pearson_zero_terms(counts, table))
    got = np.array([r["pcs"] for r in scores.orderBy("cell_id").collect()])
    assert got.shape == (60, 4)
    for k in range(4):
        assert abs(abs(got[:, k] @ u[:, k]) - 1) < 1e-6
    ve = [r["variance_explained"] for r in explained.orderBy("component").collect()]
    assert np.allclose(ve, (s**2 / (s**2).sum())[:4], rtol=1e-8)


def test_gene_set_of_many_genes(spark):
    """A set of twenty thousand genes, whose square matrix no task could hold."""
    rng = np.random.default_rng(12)
    genes, cells = 20_000, 12
    a, b = rng.normal(size=cells), rng.normal(size=genes)
    i, j = rng.integers(0, genes, 120_000), rng.integers(0, cells, 120_000)
    x = pd.DataFrame({"gene_id": i, "cell_id": j}).drop_duplicates()
    x["value"] = a[x.cell_id] * b[x.gene_id] + 0.1 * rng.normal(size=len(x))
    dense = np.zeros((cells, genes))
    dense[x.cell_id, x.gene_id] = x.value
    sets = spark.createDataFrame([("big", list(range(genes))), ("small", [3, 4, 5])], ["set_id", "genes"])
    got = D.gene_set_scores(spark.createDataFrame(x), sets).where("set_id = 'big'").toPandas()
    left = np.linalg.svd(dense, full_matrices=False)[0][:, 0]
    own = got.sort_values("cell_id").score.to_numpy()
    assert abs(abs(own @ left) - 1) < 1e-8


@pytest.mark.parametrize("rows, dims", [(15, 256), (90, 1)])
def test_pca_matches_svd(spark, rows, dims, monkeypatch):
    monkeypatch.setattr(D, "_DIMS", dims)  # one dimension: the space starts again in every step
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, 3)) @ np.diag([6, 3, 1.5]) @ rng.normal(size=(3, 40)) + 0.1 * rng.normal(size=(rows, 40))
    x[rng.random(x.shape) < 0.2] = 0.0
    scores, explained = D.pca(matrix(spark, x), 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = np.array([r["pcs"] for r in scores.orderBy("cell_id").collect()])
    for k in range(3):
        assert abs(abs(got[:, k] @ vt[k]) - 1) < 1e-5
    ve = [r["variance_explained"] for r in explained.orderBy("component").collect()]
    assert np.allclose(ve, (s**2 / (s**2).sum())[:3], rtol=1e-6)


def test_gene_sets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 30)) + 1.0
    sets = spark.createDataFrame([("a", ["g01", "g03", "g07", "zz"]), ("b", ["g02"]), ("c", ["g00", "g09"])], ["set_id", "genes"])
    got = D.gene_set_scores(matrix(spark, x), sets).toPandas()
    assert set(got.set_id) == {"a", "c"}
    for name, idx in (("a", [1, 3, 7]), ("c", [0, 9])):
        v = np.linalg.svd(x[idx], full_matrices=False)[2][0]
        mine = got[got.set_id == name].sort_values("cell_id")["score"].to_numpy()
        assert abs(abs(mine @ v) - 1) < 1e-8


def test_scores_of_many_sets_are_summed_side_by_side(spark):
    """An entry is not read once for each set of its gene; a cell without a gene of a set has no score."""
    rng = np.random.default_rng(21)
    x = rng.random(size=(9, 60)) + 0.5
    x[rng.random(x.shape) < 0.6] = 0.0
    sets = {f"s{i:02d}": sorted(rng.choice(9, 2 + i % 3, replace=False).tolist()) for i in range(40)}
    rows = [(k, [f"g{i:02d}" for i in v]) for k, v in sets.items()] + [("one", ["g01"]), (None, ["g01", "g02"])]
    entries = matrix(spark, x)
    out = D.gene_set_scores(entries, spark.createDataFrame(rows, "set_id string, genes array<string>"))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["set_id", "cell_id", "score"]
    assert "HashAggregate(keys=[_chunk" in text and "HashAggregate(keys=[set_id" not in text
    got = {(r["set_id"], r["cell_id"]): r["score"] for r in out.collect()}
    stored = {(r["gene_id"], r["cell_id"]) for r in entries.collect()}
    assert got.keys() == {(k, j) for k, v in sets.items() for j in range(60) if any((f"g{i:02d}", j) in stored for i in v)}
    for k, v in sets.items():
        first = np.linalg.svd(x[v], full_matrices=False)[2][0]
        mine = np.array([got.get((k, j), 0.0) for j in range(60)])
        assert abs(abs(mine @ first) - 1) < 1e-8


def test_steps_of_sparse_samples_leave_the_entries_alone(spark, monkeypatch):
    """With few entries by sample only the scores at the end read the entries again, and the
    results are those of steps over the entries."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(8, 200)) + 1.0
    x[rng.random(x.shape) < 0.5] = 0.0
    sets = spark.createDataFrame([("a", ["g01", "g03", "g07"]), ("b", ["g00", "g03", "g05", "g06"])], ["set_id", "genes"])
    zeros = (
        spark.createDataFrame([(j, [1.0 + j % 3]) for j in range(200)], ["cell_id", "a"]),
        spark.createDataFrame([(f"g{i:02d}", [0.1 * i]) for i in range(8)], ["gene_id", "b"]),
    )
    read, times = [], D._Matrix.times
    monkeypatch.setattr(D._Matrix, "times", lambda self, *a: read.append(1) or times(self, *a))

    def results():
        out = []
        for found in (D.pca(matrix(spark, x), 2)[0], D.pca(matrix(spark, x), 2, zeros=zeros)[0]):
            out.append(np.array([r["pcs"] for r in found.orderBy("cell_id").collect()]))
        got = D.gene_set_scores(matrix(spark, x), sets).orderBy("set_id", "cell_id").collect()
        return [*out, np.array([r["score"] for r in got])]

    mine = results()
    assert len(read) == 3
    monkeypatch.setattr(D, "_PAIRS", -1)
    for a, b in zip(mine, results()):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-8)


def test_match_scores_are_summed_once_by_cell(spark):
    """A cell over many partitions and batches has one row by donor, without a second sum."""
    from varloom.operators.allelic import sample_match_score

    ase = [(s, f"c{s % 3}", s % 2 * 5, 20) for s in range(300)] + [(7, None, 5, 20)]
    types = "site_id long, sample_id string, allele_count long, total_count long"
    table = spark.createDataFrame(ase, types).repartition(5)
    genotype = [(s, d, float((s + d) % 2)) for s in range(300) for d in range(3)]
    known = spark.createDataFrame(genotype, "site_id long, individual_id long, dosage double")
    want: dict = {}
    for s, c, a, n in ase:
        for d in range(3):
            m = want.setdefault((c, d), [0, 0])
            m[0] += (min(a, n - a) > 0) == ((s + d) % 2 == 1)
            m[1] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = sample_match_score(table, known)
        got = {(r.sample_id, r.individual_id): [r.n_match, r.n_sites] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert "HashAggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_send_the_starts_of_groups_to_the_rows(spark):
    """A group that holds most rows is not dealt to one task for its first rank."""
    f = spark.createDataFrame([("a" if i % 9 else "b", i) for i in range(900)], "k string, v long")
    out = ranked(f, ["v"], by=["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2
    assert {r.rank for r in out.where("k = 'b'").collect()} == set(range(1, 101))


def test_cell_cycle(spark):
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal(size=(40, 25))) + np.linspace(0.1, 2, 40)[:, None]
    s_genes, g2m = ["g05", "g20", "g33"], ["g11", "g28", "g39"]
    got = D.score_cell_cycle(matrix(spark, x), s_genes, g2m, 25, seed=2).toPandas().sort_values("cell_id")
    mean = x.mean(1)
    rank = mean.argsort().argsort() + 1
    items = max(round(40 / 24), 1)
    for genes, column in ((s_genes, "s_score"), (g2m, "g2m_score")):
        idx = [int(g[1:]) for g in genes]
        bins = rank // items
        control = set()
        for b in {bins[i] for i in idx}:
            members = sorted((md5(2, f"g{i:02d}"), i) for i in np.where(bins == b)[0])
            control |= {i for _, i in members[:3]}
        control -= set(idx)
        assert np.allclose(got[column], x[idx].mean(0) - x[sorted(control)].mean(0))
    low = (got.s_score < 0) & (got.g2m_score < 0)
    assert ((got.phase == "G1") == low).all()


def test_ppca_noise_falls(spark):
    rng = np.random.default_rng(7)
    w, z = rng.normal(size=(30, 2)), rng.normal(size=(2, 50))
    x = w @ z + 0.2 * rng.normal(size=(30, 50))
    i, j = np.nonzero(rng.random(x.shape) < 0.6)
    df = spark.createDataFrame(pd.DataFrame({"site_id": i, "sample_id": j, "scaled_ratio": x[i, j]}))
    scores, _, noise = D.ppca_missing(df, 2, iterations=12)
    assert noise[-1] < 0.15 and all(b <= a * 1.001 for a, b in zip(noise[2:], noise[3:]))
    est = np.array([r["z"] for r in scores.orderBy("sample_id").collect()])
    fit = est @ np.linalg.lstsq(est, z.T, rcond=None)[0]
    assert 1 - ((z.T - fit) ** 2).sum() / (z**2).sum() > 0.9


def test_combat_against_dense(spark):
    rng = np.random.default_rng(8)
    g, n = 12, 30
    batch = np.arange(n) % 3
    x = rng.normal(size=(g, n)) + np.array([0, 1.0, -0.5])[batch] + rng.normal(size=(g, 1))
    df = matrix(spark, x)
    got = D.combat(df, spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "batch": batch})))
    got = got.toPandas().pivot(index="gene_id", columns="cell_id", values="value").to_numpy()
    means = np.stack([x[:, batch == b].mean(1) for b in range(3)], 1)
    grand = (means * 10).sum(1) / n
    sd = np.sqrt(((x - means[:, batch]) ** 2).mean(1))
    s = (x - grand[:, None]) / sd[:, None]
    want = np.zeros_like(x)
    for b in range(3):
        sb = s[:, batch == b]
        gh, dh, m = sb.mean(1), sb.var(1, ddof=1), 10
        gb, t2 = gh.mean(), gh.var(ddof=1)
        a = (2 * dh.var(ddof=1) + dh.mean() ** 2) / dh.var(ddof=1)
        bb = (dh.mean() * dh.var(ddof=1) + dh.mean() ** 3) / dh.var(ddof=1)
        gs, ds = gh.copy(), dh.copy()
        for _ in range(500):
            gs = (t2 * m * gh + ds * gb) / (t2 * m + ds)
            ds = (0.5 * ((sb - gs[:, None]) ** 2).sum(1) + bb) / (m / 2 + a - 1)
        want[:, batch == b] = ((sb - gs[:, None]) / np.sqrt(ds)[:, None]) * sd[:, None] + grand[:, None]
    assert np.allclose(got, want, atol=1e-6)


def allelic(seed=0, n_ind=6, per=8, sites=12):
    rng = np.random.default_rng(seed)
    n = n_ind * per
    z = np.repeat(np.arange(n_ind), per)
    u, v = rng.normal(size=n), rng.normal(size=sites)
    p = 1 / (1 + np.exp(-(0.3 + np.outer(u, v))))
    total = rng.integers(3, 40, (n, sites))
    c = 20.0
    y = rng.binomial(total, rng.beta(c * p, c * (1 - p)))
    i, j = np.nonzero(rng.random(total.shape) < 0.8)
    f = pd.DataFrame({"sample_id": i, "site_id": j, "individual_id": z[i], "allele_count": y[i, j], "total_count": total[i, j]})
    cells = pd.DataFrame({"sample_id": np.arange(n), "age": rng.normal(size=n)})
    return f, cells, u, rng


def test_ase_als(spark):
    f, cells, u, _ = allelic()
    df = spark.createDataFrame(f)
    loads, sites, history = A.ase_als(df, 1, cells=spark.createDataFrame(cells), cov=["age"], iterations=3, newton_steps=3)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(history, history[1:])) and history[-1] > history[0]
    est = np.array([r["u"][0] for r in loads.orderBy("sample_id").collect()])
    assert abs(np.corrcoef(est, u)[0, 1]) > 0.8
    assert sites.count() == 12
    _, s2, h2 = A.ase_als(df, 1, concentration=10.0, iterations=2, newton_steps=2)
    assert s2.where("concentration != 10.0").isEmpty() and h2[-1] >= h2[0]
    folded = df.withColumn("allele_count", F.least("allele_count", F.col("total_count") - F.col("allele_count")))
    _, _, h3 = A.ase_als(folded, 1, family="folded_binomial", iterations=2, newton_steps=2)
    assert h3[-1] >= h3[0] - 1e-6 * abs(h3[0])


def test_ase_em(spark):
    f, _, _, rng = allelic(1)
    flip = rng.random((6, 12)) < 0.5
    turned = flip[f.individual_id, f.site_id]
    f["allele_count"] = np.where(turned, f.total_count - f.allele_count, f.allele_count)
    _, sites, phi, history = A.ase_em(spark.createDataFrame(f), 1, iterations=2, newton_steps=2)
    assert history[-1] > history[0]
    rows = phi.collect()
    assert len(rows) == 72 and all(abs(sum(r["phi"]) - 1) < 1e-9 for r in rows)
    assert all(abs(sum(r["weights"]) - 1) < 1e-9 for r in sites.collect())


def test_combat_counts_absent_rows_as_zeros(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.8, size=(10, 24)).astype(float)
    batch = np.arange(24) % 3
    batches = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(24), "batch": batch}))
    i, j = np.indices(x.shape)
    every = pd.DataFrame({"gene_id": i.ravel(), "cell_id": j.ravel(), "value": x.ravel()})
    dense = D.combat(spark.createDataFrame(every), batches).toPandas()
    want = dense.pivot(index="gene_id", columns="cell_id", values="value").to_numpy()
    i, j = np.nonzero(x)
    stored = spark.createDataFrame(pd.DataFrame({"gene_id": i, "cell_id": j, "value": x[i, j]}))
    got = D.combat(stored, batches, zeros=True).toPandas()
    assert np.allclose(got["value"], want[got["gene_id"], got["cell_id"]])
    for gene, b, zero in got[["gene_id", "batch", "zero_value"]].itertuples(index=False):
        absent = (x[gene] == 0) & (batch == b)
        assert np.allclose(want[gene, absent], zero)


def test_normalize_pseudobulk_counts_zeros_within_cell_types(spark):
    from varloom.operators.normalize import normalize_pseudobulk

    rng = np.random.default_rng(4)
    rows = []
    for kind, n in (("A", 4), ("B", 7)):
        x = rng.poisson(1.2, size=(n, 6))
        x[:, 0] += 1
        for s, g in zip(*np.nonzero(x)):
            rows.append((kind, f"{kind}{s}", f"g{g}", float(x[s, g])))
    df = spark.createDataFrame(rows, "cell_type string, sample_id string, gene_id string, count double")
    got = normalize_pseudobulk(df, within=["cell_type"], zeros=True).toPandas()
    table = df.toPandas()
    for kind, own in table.groupby("cell_type"):
        dense = own.pivot(index="sample_id", columns="gene_id", values="count").fillna(0)
        logged = np.log1p(1e4 * dense.div(dense.sum(axis=1), axis=0))
        z = (logged - logged.mean()) / logged.std(ddof=0)
        for r in got[got["cell_type"] == kind].itertuples():
            assert np.isclose(r.value, z.loc[r.sample_id, r.gene_id])
            zero = -logged[r.gene_id].mean() / logged[r.gene_id].std(ddof=0)
            assert np.isclose(r.zero_value, zero)


def test_quantile_normalization_counts_absent_zeros(spark):
    from varloom.operators.normalize import quantile_normalize

    rng = np.random.default_rng(9)
    x = rng.poisson(1.2, size=(40, 6)).astype(float)
    x[:, 5] *= -1
    order = np.argsort(x, axis=0, kind="stable")
    mean = np.take_along_axis(x, order, axis=0).mean(axis=1)
    want = np.zeros_like(x)
    for s in range(6):
        for v in np.unique(x[:, s]):
            tied = np.sort(x[:, s]) == v
            want[x[:, s] == v, s] = np.median(mean[tied])
    i, j = np.nonzero(x)
    df = spark.createDataFrame(pd.DataFrame({"gene_id": i, "sample_id": j, "value": x[i, j]}))
    got = quantile_normalize(df, zero_value=True).collect()
    assert len(got) == len(i)
    for r in got:
        assert np.isclose(r.value, want[r.gene_id, r.sample_id])
        assert np.isclose(r.zero_value, want[np.flatnonzero(x[:, r.sample_id] == 0)[0], r.sample_id])


def test_cis_rows_keep_donors_without_a_count(spark):
    from varloom.plans.cis_eqtl import cis_rows

    cells = spark.createDataFrame([(i, i) for i in range(6)], "cell_id int, individual_id int")
    counts = spark.createDataFrame(
        [(i, "g", 1.0 + i) for i in range(4)] + [(i, "h", 2.0) for i in range(6)],
        "cell_id int, gene_id string, count double",
    )
    genes = spark.createDataFrame([("g", 1, 100)], "gene_id string, chrom int, gene_tss long")
    genotype = spark.createDataFrame([("v", 1, 100, i, float(i % 2)) for i in range(6)], "variant_id string, chrom int, pos long, individual_id int, dosage double")
    got = {r.individual_id: r.value for r in cis_rows(counts, cells, genes, genotype, distance=10).collect()}
    v = np.log1p([1e4 * (1.0 + i) / (3.0 + i) if i < 4 else 0.0 for i in range(6)])
    z = (v - v.mean()) / v.std()
    assert sorted(got) == list(range(6)) and np.allclose([got[i] for i in range(6)], z)


def test_pseudobulk_components_count_absent_rows_as_zeros(spark):
    from varloom.plans.factor_input import pseudobulk_components

    rng = np.random.default_rng(8)
    x = rng.poisson(1.0, size=(9, 7))
    x[:, 0] += 1
    s, g = np.nonzero(x)
    counts = pd.DataFrame({"cell_id": s, "gene_id": [f"g{i}" for i in g], "count": x[s, g].astype(float)})
    cells = pd.DataFrame({"cell_id": range(9), "individual_id": range(9), "cell_type": "A"})
    two = pd.concat([cells, cells.assign(cell_id=cells.cell_id + 100, cell_type="B").iloc[:6]])
    more = counts[counts.cell_id < 6].assign(cell_id=counts.cell_id + 100)
    z, scores, shares = pseudobulk_components(
        spark.createDataFrame(pd.concat([counts, more])), spark.createDataFrame(two), ["A", "B"], k=2
    )
    assert shares.groupBy("cell_type").count().where("count = 2").count() == 2
    z, scores = z.where("cell_type = 'A'"), scores.where("cell_type = 'A'")
    logged = np.log1p(1e4 * x / x.sum(axis=1, keepdims=True))
    want = (logged - logged.mean(axis=0)) / logged.std(axis=0)
    rows = z.collect()
    assert len(rows) == (x > 0).sum()
    assert all(np.isclose(r.value, want[r.individual_id, int(r.gene_id[1:])]) for r in rows)
    for r in rows:
        zero = np.flatnonzero(x[:, int(r.gene_id[1:])] == 0)
        assert not len(zero) or np.isclose(r.zero_value, want[zero[0], int(r.gene_id[1:])])
    left = np.linalg.svd(want)[0]
    got = np.array([r.pcs for r in sorted(scores.collect(), key=lambda r: r.individual_id)])
    assert np.allclose(abs((got * left[:, :2]).sum(axis=0)), 1)


def test_combat_query_gives_the_value_of_a_zero(spark, folder):
    from checks import QUERIES

    assert "zero_value" in QUERIES["combat"](spark, folder).columns
