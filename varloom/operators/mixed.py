"""Per-test random-intercept models, likelihood-ratio tests and heteroscedasticity tests.

A random-intercept likelihood depends on the rows only through sums by level. Spark adds
up those sums; a task then holds level statistics of a test, never its rows. With a single
grouping even the levels are merged: levels of equal size enter the likelihood as one sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import special
from varloom.operators.regression import key_schema, nan_to_null, square


def _level_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, sums and cross products (upper triangle) of the columns by key."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    complete = df.dropna(subset=[*columns, *keys])
    return complete.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.sum(c).cast("double") for c in columns]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)).cast("double") for a, b in pairs]).alias("ss"),
    )


def _size_classes(df: DataFrame, test: Sequence[str], group: str, columns: Sequence[str]) -> DataFrame:
    """Level sums merged over the levels of a test that have the same number of rows."""
    q = len(columns)
    levels = _level_sums(df, [*test, group], columns)
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    s, ss = F.col("s"), F.col("ss")
    return levels.groupBy(*test, "n").agg(
        F.count("*").cast("double").alias("m"),
        F.array(*[F.sum(s[i]) for i in range(q)]).alias("s"),
        F.array(*[F.sum(ss[i]) for i in range(len(pairs))]).alias("ss"),
        F.array(*[F.sum(s[i] * s[j]) for i, j in pairs]).alias("outer"),
    )


def _numbers(frame: pd.DataFrame, name: str) -> np.ndarray:
    """A column of arrays, or the columns of plain numbers that stand for it, as a table."""
    if name in frame:
        return np.stack(frame[name].to_numpy())
    width = 0
    while f"_{name}{width}" in frame:
        width += 1
    return np.column_stack([frame[f"_{name}{i}"].to_numpy(dtype=float) for i in range(width)])


def _with_intercept(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """Cross products of (1, columns), summed over the rows of the frame."""
    q = s.shape[1]
    out = np.zeros((q + 1, q + 1))
    out[0, 0] = n.sum()
    out[0, 1:] = out[1:, 0] = s.sum(0)
    out[1:, 1:] = square(ss.sum(0, keepdims=True), q)[0]
    return out


class OneGrouping:
    """Profile likelihood over the variance ratio of one random intercept."""

    def __init__(self, frame: pd.DataFrame):
        self.n = frame["n"].to_numpy()
        self.m = frame["m"].to_numpy()
        s = np.stack(frame["s"].to_numpy())
        outer = square(np.stack(frame["outer"].to_numpy()), s.shape[1])
        q = s.shape[1] + 1
        self.levels = np.zeros((len(frame), q, q))
        self.levels[:, 0, 0] = self.m * self.n**2
        self.levels[:, 0, 1:] = self.levels[:, 1:, 0] = s * self.n[:, None]
        self.levels[:, 1:, 1:] = outer
        self.total = _with_intercept(
            self.n * self.m, s, np.stack(frame["ss"].to_numpy())
        )
        self.rows = float((self.n * self.m).sum())

    def weighted(self, theta: Sequence[float]) -> tuple[np.ndarray, float]:
        """Cross products in the metric of the inverse covariance, and its log determinant."""
        r = theta[0]
        shrink = r / (1.0 + self.n * r)
        return (
            self.total - np.tensordot(shrink, self.levels, 1),
            float((self.m * np.log1p(self.n * r)).sum()),
        )


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j], for sorted a and b."""
    low, high = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    size = high - low
    i = np.repeat(np.arange(len(a)), size)
    return i, np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def _summed(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices, sorted, with the sums of their values."""
    distinct, place = np.unique(index, return_inverse=True)
    return distinct, np.bincount(place, value, len(distinct))


class _Entries:
    """Rows that two groupings share, as a sparse matrix (i, j, n) in the order of i."""

    def __init__(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, width: int):
        index, self.n = _summed(i.astype(np.int64) * width + j, n)
        self.i, self.j = np.divmod(index, width)
        self.width = width

    def onto(self, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The matrix, times weights by entry, transposed times a table by i."""
        rows = value[self.i] * weight[:, None]
        return np.column_stack([np.bincount(self.j, c, self.width) for c in rows.T])


class _Through:
    """Products of two entries that share an eliminated level, summed by (j, k) and by the size
    of the level, on which alone the weight of an eliminated level depends."""

    def __init__(self, left: _Entries, right: _Entries, size: np.ndarray, at_once: int = 1 << 20):
        kinds, kind = np.unique(size, return_inverse=True)
        found: list = [(np.zeros(0, np.int64), np.zeros(0))]
        cuts = np.searchsorted(right.i, left.i, side="right") - np.searchsorted(right.i, left.i)
        starts = np.flatnonzero(np.diff(np.cumsum(cuts) // at_once, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(left.i)]):
            i, j = _met(left.i[a:b], right.i)
            cell = left.j[a:b][i].astype(np.int64) * right.width + right.j[j]
            found.append(_summed(kind[left.i[a:b][i]] * (left.width * right.width) + cell, left.n[a:b][i] * right.n[j]))
        index, self.n = _summed(*(np.concatenate(x) for x in zip(*found)))
        of, cell = np.divmod(index, left.width * right.width)
        self.size = kinds[of]
        self.cells, self.place = np.unique(cell, return_inverse=True)
        self.j, self.k = np.divmod(self.cells, right.width)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.n * weight, len(self.cells))


class CrossedGroupings:
    """Profile likelihood over the variance ratios of crossed random intercepts.

    The levels of the largest grouping meet only themselves, so they are eliminated first, one
    by one. What is left is a dense system of the other groupings' levels; if the next one is
    nested, as donors are over donor-and-plate, its levels still meet only themselves and go
    the same way. Nothing has the size of the largest grouping squared.
    """

    def __init__(self, frame: pd.DataFrame, groups: Sequence[str]):
        n = frame["n"].to_numpy(dtype=float)
        s = _numbers(frame, "s")
        self.total = _with_intercept(n, s, _numbers(frame, "ss"))
        self.rows = float(n.sum())
        values = np.column_stack([n, s])
        codes = [pd.factorize(frame[g])[0] for g in groups]
        levels = [int(c.max(initial=-1)) + 1 for c in codes]
        self.order = sorted(range(len(groups)), key=lambda f: -levels[f])
        codes, self.levels = [codes[f] for f in self.order], [levels[f] for f in self.order]
        self.n = [np.bincount(c, n, m) for c, m in zip(codes, self.levels)]
        self.ztv = [
            np.column_stack([np.bincount(c, v, m) for v in values.T]) for c, m in zip(codes, self.levels)
        ]
        last = range(1, len(groups))
        self.first = {g: _Entries(codes[0], codes[g], n, self.levels[g]) for g in last}
        self.through = {
            (g, h): _Through(self.first[g], self.first[h], self.n[0]) for g in last for h in last if h >= g
        }
        self.nested = len(groups) == 3 and bool((self.through[1, 1].j == self.through[1, 1].k).all())
        if len(groups) == 3:
            self.second = _Entries(codes[1], codes[2], n, self.levels[2])
            if self.nested:
                # where the products through the first grouping lie among the second's entries
                own = self.second.i * self.levels[2] + self.second.j
                self.place = np.searchsorted(own, self.through[1, 2].cells)
                self.pair_i, self.pair_j = _met(self.second.i, self.second.i)
                self.pair = self.second.j[self.pair_i] * self.levels[2] + self.second.j[self.pair_j]

    def weighted(self, theta: Sequence[float]) -> tuple[np.ndarray, float]:
        """Cross products in the metric of the inverse covariance, and its log determinant."""
        ratio = [theta[f] for f in self.order]
        root = np.sqrt(ratio)
        last = range(1, len(ratio))
        diagonal = 1.0 + ratio[0] * self.n[0]
        logdet = float(np.log(diagonal).sum())
        half = root[0] * self.ztv[0]
        out = self.total - half.T @ (half / diagonal[:, None])
        right = {
            g: root[g] * (self.ztv[g] - self.first[g].onto(half / diagonal[:, None], root[0] * self.first[g].n))
            for g in last
        }

        def block(g: int, h: int) -> np.ndarray:
            """What is left of two groupings' products, by cell of ``through``."""
            t = self.through[g, h]
            return -root[g] * root[h] * ratio[0] * t.sums(1.0 / (1.0 + ratio[0] * t.size))

        def dense(g: int, h: int) -> np.ndarray:
            t, full = self.through[g, h], np.zeros((self.levels[g], self.levels[h]))
            full[t.j, t.k] = block(g, h)
            if g == h:
                full[np.diag_indices(self.levels[g])] += 1.0 + ratio[g] * self.n[g]
            else:
                full[self.second.i, self.second.j] += root[g] * root[h] * self.second.n
            return full

        if self.nested:
            diagonal = 1.0 + ratio[1] * self.n[1]
            diagonal[self.through[1, 1].j] += block(1, 1)
            entries = root[1] * root[2] * self.second.n
            np.add.at(entries, self.place, block(1, 2))
            logdet += float(np.log(diagonal).sum())
            solved = right[1] / diagonal[:, None]
            out = out - right[1].T @ solved
            rest = right[2] - self.second.onto(solved, entries)
            inner = dense(2, 2)
            size = self.levels[2]
            weight = entries[self.pair_i] * entries[self.pair_j] / diagonal[self.second.i[self.pair_i]]
            inner -= np.bincount(self.pair, weight, size * size).reshape(size, size)
        elif len(ratio) == 3:
            cross = dense(1, 2)
            inner = np.block([[dense(1, 1), cross], [cross.T, dense(2, 2)]])
            rest = np.concatenate([right[1], right[2]])
        else:
            inner, rest = dense(1, 1), right[1]
        chol = np.linalg.cholesky(inner)
        half = np.linalg.solve(chol, rest)
        return out - half.T @ half, logdet + 2.0 * float(np.log(np.diag(chol)).sum())


def _profile(model, columns: Sequence[int], theta, reml: bool):
    """Deviance at the ratio with coefficients, inverse information and residual variance.

    ``columns`` index (intercept, predictors) of the cross products; y is the last column.
    """
    w, logdet = model.weighted(theta)
    idx = np.asarray(columns)
    xx, xy, yy = w[np.ix_(idx, idx)], w[idx, -1], w[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inverse = np.linalg.pinv(xx / scale[:, None] / scale[None, :], rcond=1e-12, hermitian=True)
    inverse = inverse / scale[:, None] / scale[None, :]
    beta = inverse @ xy
    rss = max(float(yy - beta @ xy), 1e-300)
    left = model.rows - (len(idx) if reml else 0)
    if left <= 0:
        return np.inf, beta, inverse, np.nan
    sigma2 = rss / left
    deviance = left * (np.log(2 * np.pi * sigma2) + 1.0) + logdet
    if reml:
        sign, value = np.linalg.slogdet(xx)
        if sign <= 0:
            return np.inf, beta, inverse, np.nan
        deviance += value
    return deviance, beta, inverse, sigma2


def _best_ratio(model, columns, n_factors: int, reml: bool):
    """Variance ratios of least deviance: a coarse search by factor, then refinement."""

    def cost(theta):
        return _profile(model, columns, theta, reml)[0]

    grid = np.concatenate([[0.0], np.logspace(-4, 3, 15)])
    theta = np.zeros(n_factors)
    best = cost(theta)
    for _ in range(2 if n_factors > 1 else 1):
        for f in range(n_factors):
            for value in grid:
                trial = theta.copy()
                trial[f] = value
                c = cost(trial)
                if c < best - 1e-12:
                    best, theta = c, trial
    # pattern search on the square roots, down to a relative step of 1e-7
    root = np.sqrt(theta)
    step = np.maximum(root * 0.5, 0.02)
    while np.any(step > 1e-7 * np.maximum(root, 1e-3)):
        moved = False
        for f in range(n_factors):
            for sign in (1.0, -1.0):
                trial = root.copy()
                trial[f] = max(trial[f] + sign * step[f], 0.0)
                c = cost(trial**2)
                if c < best - 1e-13:
                    best, root, moved = c, trial, True
                    step[f] *= 1.5
                    break
            else:
                step[f] *= 0.5
        if not moved and np.all(step <= 1e-7 * np.maximum(root, 1e-3)):
            break
    return root**2, best


def _satterthwaite(model, columns, theta: float, sigma2: float, which: int) -> float:
    """Degrees of freedom of a coefficient from the curvature of the REML deviance in the
    residual and group variances."""
    p = len(columns)
    if theta <= 0:
        return model.rows - p

    def parts(params):
        s2, u2 = params
        w, logdet = model.weighted([u2 / s2])
        idx = np.asarray(columns)
        xx, xy, yy = w[np.ix_(idx, idx)], w[idx, -1], w[-1, -1]
        inverse = np.linalg.pinv(xx, hermitian=True)
        rss = float(yy - xy @ inverse @ xy)
        dev = (model.rows - p) * np.log(s2) + logdet + np.linalg.slogdet(xx)[1] + rss / s2
        return dev, s2 * inverse[which, which]

    at = np.array([sigma2, theta * sigma2])
    h = at * 1e-3
    hessian, gradient = np.zeros((2, 2)), np.zeros(2)
    for i in range(2):
        up, down = at.copy(), at.copy()
        up[i] += h[i]
        down[i] -= h[i]
        gradient[i] = (parts(up)[1] - parts(down)[1]) / (2 * h[i])
        for j in range(2):
            total = 0.0
            for si in (1, -1):
                for sj in (1, -1):
                    point = at.copy()
                    point[i] += si * h[i]
                    point[j] += sj * h[j]
                    total += si * sj * parts(point)[0]
            hessian[i, j] = total / (4 * h[i] * h[j])
    try:
        spread = gradient @ (2.0 * np.linalg.inv(hessian)) @ gradient
    except np.linalg.LinAlgError:
        return model.rows - p
    variance = parts(at)[1]
    return 2 * variance**2 / spread if spread > 0 else model.rows - p


def grouped_lmm(
    df: DataFrame,
    test: Sequence[str],
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
    group: str = "individual_id",
) -> DataFrame:
    """Per test REML fit of y on x and covariates with a random intercept of the group:
    effect, standard error, p-value with Satterthwaite degrees of freedom, random-effect and
    residual sd, and the fixed coefficients."""
    columns = [x, *covariates, y]
    fixed = list(range(len(columns)))  # intercept, x, covariates
    stats = _size_classes(df, test, group, columns)
    names = ("beta", "standard_error", "pvalue", "re_sd", "residual_sd", "df", "theta")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        model = OneGrouping(frame)
        out = frame[list(test)].iloc[:1].copy()
        theta, _ = _best_ratio(model, fixed, 1, True)
        _, beta, inverse, sigma2 = _profile(model, fixed, theta, True)
        se = np.sqrt(sigma2 * inverse[1, 1])
        df_left = _satterthwaite(model, fixed, theta[0], sigma2, 1)
        ok = np.isfinite(se) and se > 0 and df_left > 0
        tail = special.student_t_two_sided(beta[1] / se, df_left) if ok else np.nan
        out["n"] = int(model.rows)
        values = (
            beta[1] if ok else np.nan, se if ok else np.nan, float(tail),
            np.sqrt(theta[0] * sigma2), np.sqrt(sigma2), df_left, theta[0],
        )
        for name, value in zip(names, values):
            out[name] = value
        out["coefficients"] = [beta]
        return out

    schema = (
        f"{key_schema(df, test)}, n bigint, "
        + ", ".join(f"{c} double" for c in names)
        + ", coefficients array<double>"
    )
    fits = stats.groupBy(*test).applyInPandas(fit, schema)
    return nan_to_null(fits, ("beta", "standard_error", "pvalue"))


def lmm_lrt(
    df: DataFrame,
    test: Sequence[str],
    *,
    null: Sequence[str],
    extra: Sequence[str],
    groups: Sequence[str],
    y: str = "y",
) -> DataFrame:
    """Likelihood-ratio test of nested ML mixed models: ``null`` columns against ``null`` and
    ``extra`` columns, with one to three crossed random intercepts."""
    if not 1 <= len(groups) <= 3:
        raise ValueError("one to three grouping columns")
    columns = [*null, *extra, y]
    small = list(range(1 + len(null)))
    full = list(range(1 + len(null) + len(extra)))
    single = len(groups) == 1
    if single:
        stats = _size_classes(df, test, groups[0], columns)
    else:
        stats = _level_sums(df, [*test, *groups], columns)
        # plain numbers: an array for every level would fill a worker's memory
        pairs = len(columns) * (len(columns) + 1) // 2
        stats = stats.select(
            *test, *groups, "n",
            *[F.col("s")[i].alias(f"_s{i}") for i in range(len(columns))],
            *[F.col("ss")[i].alias(f"_ss{i}") for i in range(pairs)],
        )
    n_groups, names = len(groups), list(groups)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        model = OneGrouping(frame) if single else CrossedGroupings(frame, names)
        theta, full_dev = _best_ratio(model, full, n_groups, False)
        _, beta, _, sigma2 = _profile(model, full, theta, False)
        _, null_dev = _best_ratio(model, small, n_groups, False)
        out = frame[list(test)].iloc[:1].copy()
        lr = max(null_dev - full_dev, 0.0)
        out["n"] = int(model.rows)
        out["lr"] = lr
        out["pvalue"] = float(special.chi2_tail(lr, len(extra)))
        out["effects"] = [beta[len(small):]]
        out["re_sd"] = [np.sqrt(theta * sigma2)]
        return out

    schema = (
        f"{key_schema(df, test)}, n bigint, lr double, pvalue double, "
        "effects array<double>, re_sd array<double>"
    )
    return stats.groupBy(*test).applyInPandas(fit, schema)


def eqtl_lrt(df, test, *, x="x", covariates=(), groups, y="y") -> DataFrame:
    """Test of the genotype effect."""
    return lmm_lrt(df, test, null=list(covariates), extra=[x], groups=groups, y=y)


def dynamic_lrt(
    df, test, *, x="x", pseudotime="pseudotime", covariates=(), groups, y="y", quadratic=False
) -> DataFrame:
    """Test of the genotype x pseudotime interaction; ``quadratic`` adds squared pseudotime to
    both models and its interaction to the full one (two degrees of freedom)."""
    t = F.col(pseudotime)
    rows = df.withColumn("_xt", F.col(x) * t)
    null, extra = [x, *covariates, pseudotime], ["_xt"]
    if quadratic:
        rows = rows.withColumns({"_t2": t * t, "_xt2": F.col(x) * t * t})
        null, extra = [*null, "_t2"], ["_xt", "_xt2"]
    return lmm_lrt(rows, test, null=null, extra=extra, groups=groups, y=y)


def modulated_lrt(
    df, test, *, x="x", covariates, individual="individual_id", plate="plate_id", y="y"
) -> DataFrame:
    """Joint test of all genotype x covariate interactions, with random intercepts of donor,
    plate and donor within plate."""
    rows = df.withColumns({f"_x_{c}": F.col(x) * F.col(c) for c in covariates}).withColumn(
        "_both", F.concat_ws("_", F.col(individual).cast("string"), F.col(plate).cast("string"))
    )
    return lmm_lrt(
        rows,
        test,
        null=[x, *covariates],
        extra=[f"_x_{c}" for c in covariates],
        groups=[individual, plate, "_both"],
        y=y,
    )


def het_test(
    df: DataFrame,
    test: Sequence[str],
    *,
    y: str = "y",
    x: str = "x",
    covariates: Sequence[str] = (),
    group: str = "individual_id",
) -> DataFrame:
    """Breusch-Pagan tests of the mixed-model residuals on x: the studentised form n R^2 and
    the F form; with the share of the random-effect variance."""
    columns = [x, *covariates, y]
    fits = grouped_lmm(df, test, y=y, x=x, covariates=covariates, group=group)
    usable = fits.select(*test, "theta", "coefficients", "re_sd", "residual_sd")
    rows = df.dropna(subset=[*columns, group])
    b = F.col("coefficients")
    fitted = b[0]
    for i, c in enumerate(columns[:-1], start=1):
        fitted = fitted + b[i] * F.col(c)
    marginal = rows.join(usable, list(test)).withColumn("_e", F.col(y) - fitted)
    shrink = F.col("theta") / (1 + F.count("*") * F.col("theta"))
    random = marginal.groupBy(*test, group, "theta").agg((shrink * F.sum("_e")).alias("_u"))
    error = marginal.join(random.drop("theta"), [*test, group]).withColumn(
        "_e2", (F.col("_e") - F.col("_u")) ** 2
    )
    r2 = error.groupBy(*test).agg(
        F.regr_r2("_e2", x).alias("_r2"), F.count("*").alias("n")
    )
    names = ("het_pvalue", "het_f_pvalue")

    def tails(frames):
        for frame in frames:
            value, n = frame["_r2"].to_numpy(dtype=float), frame["n"].to_numpy(dtype=float)
            good = np.isfinite(value) & (value < 1) & (n > 2)
            v, m = np.where(good, value, 0.0), np.where(good, n, 3.0)
            out = frame[[*test, "n"]].copy()
            out["het_pvalue"] = np.where(good, special.chi2_tail(m * v, 1.0), np.nan)
            f = v / (1 - v) * (m - 2)
            out["het_f_pvalue"] = np.where(good, special.f_tail(f, 1.0, m - 2), np.nan)
            yield out

    schema = f"{key_schema(df, test)}, n bigint, het_pvalue double, het_f_pvalue double"
    tested = nan_to_null(r2.mapInPandas(tails, schema), names)
    share = F.col("re_sd") ** 2 / (F.col("re_sd") ** 2 + F.col("residual_sd") ** 2)
    return tested.join(usable.select(*test, share.alias("re_fraction")), list(test))
