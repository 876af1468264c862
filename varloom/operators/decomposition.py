"""Singular vectors, gene-set and cell-cycle scores, missing-data PCA, batch correction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.plans.scale import (
    broadcast_if_small,
    bucketed,
    buckets_for,
    cut_lineage,
    discard,
    hash_order,
    ranked,
    settled,
    with_group_stats,
)

# Vectors that a search space holds before it starts again from its best ones.
_DIMS = 256

# Products of two entries of a sample, by entry, up to which the products of all pairs of features
# are added up once instead of reading the entries in every step.
_PAIRS = 64

# Gene sets whose scores of a cell are summed side by side.
_SETS = 16


def _array_sums(column: str, width: int):
    return F.array(*[F.sum(F.col(column)[i]) for i in range(width)])


def _rows_of(frame: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(frame[column].to_numpy()).astype(float)


@dataclass
class _Matrix:
    """A sparse matrix by group: stored entries, less what the zero terms say there, and the
    terms themselves. An entry is x + sum over r of a[r] * b[r]. Entries without the columns of
    the group belong to all groups that have their feature."""

    entries: DataFrame  # [by], sample, feature, _x
    samples: DataFrame  # by, sample, [_a]
    by: list[str]
    sample: str
    feature: str
    terms: int
    gram: DataFrame | None = None  # by, feature, _other, _p: products of pairs of features

    def __post_init__(self):
        if self.gram is not None:
            return
        # counted once: whether a block of vectors over the samples may be broadcast, by width
        rows = self.samples.count()
        self.hint = lambda df, width: F.broadcast(df) if rows * (8 * width + 64) <= 64 << 20 else df

    def images(self, space: DataFrame, column: str, width: int) -> DataFrame:
        """The features with ``_y``: the transposed matrix times the matrix times a block."""
        if self.gram is None:
            between = cut_lineage(self.times(space, column, width))
            return self.transposed(space, between, width)
        other = [F.col(c) for c in self.by] + [F.col(self.feature).alias("_other")]
        block = space.select(*other, F.col(column).alias("_b"))
        found = self.gram.join(broadcast_if_small(block, width=width + 2), [*self.by, "_other"])
        found = found.groupBy(*self.by, self.feature).agg(
            F.array(*[F.sum(F.col("_p") * F.col("_b")[i]) for i in range(width)]).alias("_y")
        )
        none = F.array_repeat(F.lit(0.0), width)
        joined = space.join(found, [*self.by, self.feature], "left")
        return joined.withColumn("_y", F.coalesce("_y", none))

    def times(self, features: DataFrame, column: str, width: int) -> DataFrame:
        """(by, sample, _b): the matrix times a block of vectors over features."""
        keys = [c for c in [*self.by, self.feature] if c in self.entries.columns]
        block = features.select(*self.by, self.feature, F.col(column).alias("_v"))
        found = self.entries.join(broadcast_if_small(block, width=width + 2), keys)
        found = found.groupBy(*self.by, self.sample).agg(
            F.array(*[F.sum(F.col("_x") * F.col("_v")[i]) for i in range(width)]).alias("_b")
        )
        if not self.terms:
            return found
        shared = features.groupBy(*self.by).agg(
            *[
                F.array(*[F.sum(F.col("_z")[r] * F.col(column)[i]) for i in range(width)]).alias(f"_t{r}")
                for r in range(self.terms)
            ]
        )
        return self._with_terms(self.samples, "_a", found, shared, [*self.by, self.sample], "_b", width)

    def transposed(self, features: DataFrame, samples: DataFrame, width: int) -> DataFrame:
        """The features with ``_y``: the transposed matrix times the block ``_b`` of samples."""
        found = self.entries.join(self.hint(samples, width + 2), [*self.by, self.sample])
        found = found.groupBy(*self.by, self.feature).agg(
            F.array(*[F.sum(F.col("_x") * F.col("_b")[i]) for i in range(width)]).alias("_y")
        )
        keys = [*self.by, self.feature]
        if not self.terms:
            none = F.array_repeat(F.lit(0.0), width)
            return features.join(found, keys, "left").withColumn("_y", F.coalesce("_y", none))
        whole = samples.join(self.samples, [*self.by, self.sample])
        shared = whole.groupBy(*self.by).agg(
            *[
                F.array(*[F.sum(F.col("_a")[r] * F.col("_b")[i]) for i in range(width)]).alias(f"_t{r}")
                for r in range(self.terms)
            ]
        )
        return self._with_terms(features, "_z", found, shared, keys, "_y", width)

    def _with_terms(self, rows, term, found, shared, keys, out, width) -> DataFrame:
        joined = rows.join(found, keys, "left")
        joined = joined.join(shared, self.by)
        cells = []
        for i in range(width):
            total = F.coalesce(F.col(out)[i], F.lit(0.0))
            for r in range(self.terms):
                total = total + F.col(term)[r] * F.col(f"_t{r}")[i]
            cells.append(total)
        kept = [c for c in rows.columns if c != "_a"]
        return joined.select(*kept, F.array(*cells).alias(out))

    def square_sum(self, features: DataFrame) -> DataFrame:
        """(by, _total): the sum of all squared entries."""
        x = F.col("_x")
        if not self.terms:
            return self.entries.groupBy(*self.by).agg(F.sum(x * x).alias("_total"))
        pairs = [(r, q) for r in range(self.terms) for q in range(self.terms)]

        def squares(table: DataFrame, c: str, out: str) -> DataFrame:
            cells = [F.sum(F.col(c)[r] * F.col(c)[q]) for r, q in pairs]
            return table.groupBy(*self.by).agg(F.array(*cells).alias(out))

        keys = [*self.by, self.feature], [*self.by, self.sample]
        named = self.entries.join(broadcast_if_small(features.select(*keys[0], "_z")), keys[0])
        named = named.join(broadcast_if_small(self.samples), keys[1])
        zero = F.lit(0.0)
        for r in range(self.terms):
            zero = zero + F.col("_a")[r] * F.col("_z")[r]
        stored = named.groupBy(*self.by).agg(F.sum(x * x + 2 * x * zero).alias("_s"))
        both = squares(self.samples, "_a", "_aa").join(squares(features, "_z", "_bb"), self.by)
        cells = F.aggregate(F.zip_with("_aa", "_bb", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        joined = both.join(stored, self.by, "left")
        return joined.select(*self.by, (cells + F.coalesce("_s", F.lit(0.0))).alias("_total"))


def _few_pairs(entries: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether the pairs of entries with equal keys are few beside a number of rows."""
    n = F.col("_n").cast("double")
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (sizes.agg(F.sum(n * n)).head()[0] or 0.0) <= _PAIRS * rows


def _products(entries: DataFrame, by: list[str], sample: str, feature: str) -> DataFrame:
    """(by, feature, _other, _p): the entries' products, summed over the samples."""
    other = entries.select(*by, sample, F.col(feature).alias("_other"), F.col("_x").alias("_z"))
    pairs = entries.join(other, [*by, sample])
    return pairs.groupBy(*by, feature, "_other").agg(F.sum(F.col("_x") * F.col("_z")).alias("_p"))


def _dense_products(
    stored: DataFrame, entries: DataFrame, samples: DataFrame, features: DataFrame, by, sample, feature, terms
) -> DataFrame:
    """The products of the stored entries and those with the zero terms, for all pairs of features."""
    with_a = entries.join(samples, [*by, sample]).groupBy(*by, feature).agg(
        F.array(*[F.sum(F.col("_x") * F.col("_a")[r]) for r in range(terms)]).alias("_c")
    )
    none = F.array_repeat(F.lit(0.0), terms)
    own = features.join(with_a, [*by, feature], "left").withColumn("_c", F.coalesce("_c", none))
    own = cut_lineage(own)
    pairs = [(r, q) for r in range(terms) for q in range(terms)]
    both = samples.groupBy(*by).agg(F.array(*[F.sum(F.col("_a")[r] * F.col("_a")[q]) for r, q in pairs]).alias("_aa"))
    other = own.select(*by, F.col(feature).alias("_other"), F.col("_z").alias("_z2"), F.col("_c").alias("_c2"))
    cells = own.join(broadcast_if_small(other, width=2 * terms + 2), by).join(F.broadcast(both), by)
    cells = cells.join(stored, [*by, feature, "_other"], "left")
    total = F.coalesce("_p", F.lit(0.0))
    for r in range(terms):
        total = total + F.col("_c")[r] * F.col("_z2")[r] + F.col("_z")[r] * F.col("_c2")[r]
    for i, (r, q) in enumerate(pairs):
        total = total + F.col("_z")[r] * F.col("_aa")[i] * F.col("_z2")[q]
    return cells.select(*by, feature, "_other", total.alias("_p"))


def _settled(table: DataFrame, by: list[str], dims: int, width: int, k: int) -> DataFrame:
    """The best vectors in each group's search space.

    ``table`` has, by feature, the space ``_v`` and its image ``_w``. The result has per group
    the coefficients of the best vectors, their values, the lengths of their residuals, and
    the longest of the first k beside the largest value.
    """
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in by)

    def partial(frames):
        totals: dict = {}
        for frame in frames:
            for key, part in frame.groupby(by, sort=False, dropna=False):
                v, w = _rows_of(part, "_v"), _rows_of(part, "_w")
                own = np.stack([v.T @ v, v.T @ w, w.T @ w])
                totals[key] = totals.get(key, 0.0) + own
        if totals:
            out = pd.DataFrame(list(totals), columns=by)
            out["_flat"] = [t.ravel() for t in totals.values()]
            yield out

    def solve(frame):
        flat = np.sum(np.stack(frame["_flat"].to_numpy()), 0)
        vv, vw, ww = flat.reshape(3, dims, dims)
        size = np.sqrt(np.maximum(np.diag(vv), 1e-300))
        lam, vec = np.linalg.eigh(vv / size[:, None] / size[None, :])
        keep = lam > 1e-10 * lam.max()
        half = vec[:, keep] / np.sqrt(lam[keep]) / size[:, None]
        values, turn = np.linalg.eigh(half.T @ ((vw + vw.T) / 2) @ half)
        order = np.argsort(-values)[:width]
        u = np.zeros((dims, width))
        u[:, : len(order)] = half @ turn[:, order]
        theta = np.zeros(width)
        theta[: len(order)] = np.maximum(values[order], 0.0)
        square = np.einsum("iw,ij,jw->w", u, ww, u) - theta**2
        rest = np.sqrt(np.maximum(square, 0.0))
        top = max(theta[0], 1e-300)
        out = frame[by].iloc[:1].copy()
        out["_u"], out["_theta"], out["_rest"] = [u.ravel()], [theta], [rest]
        out["_left"] = float(rest[:k].max() / top) if theta[0] > 0 else 0.0
        return out

    parts = table.select(*by, "_v", "_w").mapInPandas(partial, f"{kinds}, _flat array<double>")
    schema = f"{kinds}, _u array<double>, _theta array<double>, _rest array<double>, _left double"
    return cut_lineage(parts.groupBy(*by).applyInPandas(solve, schema))


def _leading(matrix: _Matrix, features: DataFrame, k: int, seed: int, tol: float, max_iter: int):
    """The leading right singular vectors of every group: (by, feature, [_z], _best) and
    (by, _theta).

    A space of vectors grows by the residuals of its best ones, which are orthogonal to it,
    and starts again from the best ones when it is full. Vectors stay distributed; of a group
    only sums over all features, a few hundred numbers, meet in one row.
    """
    width, by = k + min(27, max(3, 6 * k)), matrix.by
    draws = [
        F.conv(F.substring(hash_order(seed + i, *by, matrix.feature), 1, 8), 16, 10).cast("double") / 2**32 - 0.5
        for i in range(width)
    ]
    base = [c for c in features.columns]
    space = features.withColumn("_new", F.array(*draws))
    none = F.array().cast("array<double>")
    space = cut_lineage(space.withColumns({"_v": none, "_w": none}))
    dims = 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema)
    for _ in range(max_iter):
        grown = matrix.images(space, "_new", width)
        grown = grown.select(*base, F.concat("_v", "_new").alias("_v"), F.concat("_w", "_y").alias("_w"))
        grown = cut_lineage(grown, replaces=space)
        dims += width
        turn = _settled(grown, by, dims, width, k)
        left = turn.agg(F.max("_left")).head()[0]
        if left is None or left <= tol:
            break
        full = dims + width > max(_DIMS, 2 * width)

        def move(frames, dims=dims, full=full):
            for frame in frames:
                v, w, u = _rows_of(frame, "_v"), _rows_of(frame, "_w"), _rows_of(frame, "_u")
                u = u.reshape(len(frame), dims, width)
                theta, rest = _rows_of(frame, "_theta"), _rows_of(frame, "_rest")
                best = np.einsum("nd,ndw->nw", v, u)
                image = np.einsum("nd,ndw->nw", w, u)
                own = rest > tol * 1e-2 * np.maximum(theta[:, :1], 1e-300)
                new = np.where(own, (image - theta * best) / np.where(own, rest, 1.0), 0.0)
                out = frame[base].copy()
                out["_new"] = list(new)
                out["_v"], out["_w"] = (list(best), list(image)) if full else (list(v), list(w))
                yield out

        joined = grown.join(turn, by)
        schema = f"{fields}, _new array<double>, _v array<double>, _w array<double>"
        space = cut_lineage(joined.mapInPandas(move, schema), replaces=grown)
        dims = width if full else dims
    else:
        raise RuntimeError(f"the components have not settled after {max_iter} steps")

    def take(frames):
        for frame in frames:
            u = _rows_of(frame, "_u").reshape(len(frame), dims, width)[:, :, :k]
            out = frame[base].copy()
            out["_best"] = list(np.einsum("nd,ndw->nw", _rows_of(frame, "_v"), u))
            yield out

    joined = grown.join(turn, by)
    best = cut_lineage(joined.mapInPandas(take, f"{fields}, _best array<double>"), replaces=grown)
    # the entry of largest size is positive in every vector
    top = [F.max_by(F.signum(F.col("_best")[i]), F.struct(F.abs(F.col("_best")[i]), matrix.feature)) for i in range(k)]
    signs = best.groupBy(*by).agg(F.array(*top).alias("_sign"))
    best = best.join(broadcast_if_small(signs, width=k + 2), by)
    best = best.withColumn("_best", F.zip_with("_best", "_sign", lambda x, t: x * t)).drop("_sign")
    return best, turn.select(*by, F.slice("_theta", 1, k).alias("_theta"))


def _scores(matrix: _Matrix, best: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """(by, sample, pcs): the matrix times its leading vectors, over their singular values."""
    scores = matrix.times(best, "_best", k).join(broadcast_if_small(values, width=k + 2), matrix.by)
    theta = F.col("_theta")
    scaled = [
        F.when(theta[i] > 1e-12 * theta[0], F.col("_b")[i] / F.sqrt(theta[i])).otherwise(0.0) for i in range(k)
    ]
    return scores.select(*matrix.by, matrix.sample, F.array(*scaled).alias("pcs"))


def pca(
    df: DataFrame,
    k: int,
    *,
    feature: str = "gene_id",
    sample: str = "cell_id",
    value: str = "value",
    by: Sequence[str] = (),
    zeros: tuple[DataFrame, DataFrame] | None = None,
    seed: int = 0,
    tol: float = 1e-7,
    max_iter: int = 300,
) -> tuple[DataFrame, DataFrame]:
    """Singular value decomposition without centring, of one matrix or one for each ``by`` group.

    Returns unit-length sample vectors (``pcs``) and the share of the squared singular values
    of each component. Absent entries are zeros, or, with ``zeros``, what two tables say: one
    with an array ``a`` for every sample and one with an array ``b`` for every feature (and the
    ``by`` columns); an absent entry is the sum of a[r] * b[r]. Features with a NULL in ``b``
    take no part. One search serves all sizes and all groups at once; it ends when the longest
    residual is at most ``tol`` of the largest value, and raises after ``max_iter`` steps.
    """
    plain = not by
    groups = list(by) or ["_all"]

    def keyed(table: DataFrame) -> DataFrame:
        return table.withColumn("_all", F.lit(0)) if plain else table

    data = df.where(F.col(value).isNotNull()).select(*by, sample, feature, F.col(value).cast("double").alias("_x"))
    terms = 0
    if zeros is None:
        data = cut_lineage(data)  # read several times below, made once
        features = cut_lineage(keyed(data).select(*groups, feature).distinct())
    else:
        samples = cut_lineage(keyed(zeros[0]).select(*groups, sample, F.col("a").alias("_a")))
        good = F.forall("b", lambda x: x.isNotNull() & ~F.isnan(x))
        features = keyed(zeros[1]).where(good).select(*groups, feature, F.col("b").alias("_z"))
        features = cut_lineage(features)
        first = features.select(F.size("_z")).head()
        terms = first[0] if first else 1
        # entries keep only what differs from the terms
        named = keyed(data).join(broadcast_if_small(features), [*groups, feature])
        named = named.join(broadcast_if_small(samples), [*groups, sample])
        zero = F.lit(0.0)
        for r in range(terms):
            zero = zero + F.col("_a")[r] * F.col("_z")[r]
        data = cut_lineage(named.select(*by, sample, feature, (F.col("_x") - zero).alias("_x")))
    if plain:
        k = min(k, features.count())
    gram, rows = None, data.count()
    sparse = _few_pairs(data, [*by, sample], rows) and (not terms or _few_pairs(features, groups, rows))
    if sparse:
        data = bucketed(data, sample, buckets_for(rows, data.sparkSession), replaces=data)
    data = keyed(data)
    if sparse:
        gram = _products(data, groups, sample, feature)
        if terms:
            gram = _dense_products(cut_lineage(gram), data, samples, features, groups, sample, feature, terms)
        gram = cut_lineage(gram)
    if zeros is None:
        samples = data.select(*groups, sample).distinct()
    matrix = _Matrix(data, samples, groups, sample, feature, terms, gram)
    best, values = _leading(matrix, features, k, seed, tol, max_iter)
    scores = _scores(matrix, best, values, k).select(*by, sample, "pcs")
    total = matrix.square_sum(features)
    shares = values.join(broadcast_if_small(total, width=2), groups)
    explained = shares.select(*by, "_total", F.posexplode("_theta").alias("component", "_t"))
    return scores, explained.select(*by, "component", (F.col("_t") / F.col("_total")).alias("variance_explained"))


def _set_scores(matrix: _Matrix, best: DataFrame, values: DataFrame) -> DataFrame:
    """(by, sample, score): the first of ``_scores`` where entries belong to all groups. Sums are made
    by sample for _SETS groups side by side, NULL for a group that has no feature of the sample."""
    table = cut_lineage(ranked(values, matrix.by, out="_no"))
    named = best.join(broadcast_if_small(table.select(*matrix.by, "_no"), width=4), matrix.by)
    chunk = F.expr(f"_no DIV {_SETS}").alias("_chunk")
    own = [F.max(F.when(F.col("_no") % _SETS == i, F.col("_best")[0])) for i in range(_SETS)]
    packed = cut_lineage(named.groupBy(matrix.feature, chunk).agg(F.array(*own).alias("_own")))
    sums = replace(matrix, by=["_chunk"]).times(packed, "_own", _SETS)
    each = sums.select(matrix.sample, "_chunk", F.posexplode("_b").alias("_i", "_one")).where("_one IS NOT NULL")
    each = each.withColumn("_no", F.col("_chunk") * _SETS + F.col("_i"))
    each = each.join(broadcast_if_small(table, width=6), "_no")
    theta = F.col("_theta")[0]
    score = F.when(theta > 1e-12 * theta, F.col("_one") / F.sqrt(theta)).otherwise(0.0)
    return each.select(*matrix.by, matrix.sample, score.alias("score"))


def gene_set_scores(
    expr: DataFrame,
    sets: DataFrame,
    *,
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "value",
    set_id: str = "set_id",
    genes: str = "genes",
) -> DataFrame:
    """First right singular vector over the genes of each set with at least two matched
    genes: one score per (set, cell). All sets are searched at once; no set's genes meet in
    one task."""
    members = sets.select(set_id, F.explode(genes).alias(gene)).distinct()
    known = cut_lineage(members.join(expr.select(gene).distinct(), gene, "left_semi"))
    large = known.groupBy(set_id).agg(F.count("*").alias("_m")).where("_m >= 2").select(set_id)
    placed = known.join(broadcast_if_small(large, width=2), set_id)
    used = broadcast_if_small(placed.select(gene).distinct(), width=4)
    data = expr.where(F.col(value).isNotNull()).join(used, gene, "left_semi")
    data = cut_lineage(data.select(cell, gene, F.col(value).cast("double").alias("_x")))
    n = data.count()
    if _few_pairs(data, [cell], n):
        # the products of genes are added up once for all sets, and a set takes those of its genes
        data = bucketed(data, cell, buckets_for(n, data.sparkSession), replaces=data)
        features = cut_lineage(placed.join(data.select(gene).distinct(), gene, "left_semi").select(set_id, gene))
        gram = _products(data, [], cell, gene).join(broadcast_if_small(features, width=4), gene)
        other = features.select(set_id, F.col(gene).alias("_other"))
        gram = cut_lineage(gram.join(broadcast_if_small(other, width=4), [set_id, "_other"]))
        matrix = _Matrix(data, data, [set_id], cell, gene, 0, gram)
        return _set_scores(matrix, *_leading(matrix, features, 1, 0, 1e-7, 300))
    else:
        rows = data.withColumnRenamed("_x", value).join(broadcast_if_small(placed, width=4), gene)
        scores, _ = pca(rows, 1, feature=gene, sample=cell, value=value, by=[set_id])
    return scores.select(set_id, cell, F.col("pcs")[0].alias("score"))


def module_score(
    expr: DataFrame,
    genes: Sequence,
    n_cells: int,
    *,
    ctrl_size: int = 50,
    n_bins: int = 25,
    seed: int = 0,
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "value",
    out: str = "score",
) -> DataFrame:
    """Mean of the gene set minus the mean of control genes of similar expression.

    Genes are binned by the rank of their mean; each bin with a set gene gives ``ctrl_size``
    controls in hash order. Absent entries are zeros.
    """
    spark = expr.sparkSession
    wanted = spark.createDataFrame([(g,) for g in genes], [gene])
    means = expr.groupBy(gene).agg((F.sum(value) / n_cells).alias("_mean"))
    order = cut_lineage(ranked(means, ["_mean", gene], out="_rank"))
    n_genes = order.count()
    items = max(int(round(n_genes / (n_bins - 1))), 1)
    lowest = order.groupBy("_mean").agg(F.min("_rank").alias("_low"))
    binned = order.join(lowest, "_mean").select(gene, F.floor(F.col("_low") / items).alias("_bin"))
    inside = F.broadcast(wanted)
    bins = binned.join(inside, gene, "left_semi").select("_bin").distinct()
    pick = Window.partitionBy("_bin").orderBy(hash_order(seed, gene), gene)
    control = (
        binned.join(bins, "_bin", "left_semi")
        .withColumn("_k", F.row_number().over(pick))
        .where(F.col("_k") <= ctrl_size)
        .join(inside, gene, "left_anti")
    )
    signs = cut_lineage(
        binned.join(inside, gene, "left_semi")
        .select(gene, F.lit(1).alias("_side"))
        .unionByName(control.select(gene, F.lit(0).alias("_side")))
    )
    counts = {r["_side"]: r["count"] for r in signs.groupBy("_side").count().collect()}
    n_set, n_control = counts.get(1, 0), counts.get(0, 0)
    if not n_set or not n_control:
        raise ValueError("no set genes or no control genes in the table")
    weight = F.when(F.col("_side") == 1, 1.0 / n_set).otherwise(-1.0 / n_control)
    weighted = signs.select(gene, weight.alias("_w"))
    scored = expr.join(broadcast_if_small(weighted), gene, "left")
    return scored.groupBy(cell).agg(
        F.coalesce(F.sum(F.col(value) * F.col("_w")), F.lit(0.0)).alias(out)
    )


def score_cell_cycle(
    expr: DataFrame,
    s_genes: Sequence,
    g2m_genes: Sequence,
    n_cells: int,
    *,
    seed: int = 0,
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "value",
) -> DataFrame:
    """S and G2M module scores and the phase: S, G2M where its score is larger, G1 where both
    scores are negative."""
    size = min(len(s_genes), len(g2m_genes))
    names = dict(ctrl_size=size, seed=seed, gene=gene, cell=cell, value=value)
    s = module_score(expr, s_genes, n_cells, out="s_score", **names)
    g2m = module_score(expr, g2m_genes, n_cells, out="g2m_score", **names)
    phase = (
        F.when((F.col("s_score") < 0) & (F.col("g2m_score") < 0), "G1")
        .when(F.col("g2m_score") > F.col("s_score"), "G2M")
        .otherwise("S")
    )
    return s.join(g2m, cell).withColumn("phase", phase)


def ppca_missing(
    ratios: DataFrame,
    k: int,
    *,
    iterations: int = 20,
    tolerance: float | None = None,
    seed: int = 0,
    site: str = "site_id",
    sample: str = "sample_id",
    value: str = "scaled_ratio",
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Probabilistic PCA by EM over the observed entries only.

    Each half-step adds up k x k normal equations by sample or by site. Returns sample
    scores ``z``, site weights ``w`` and the noise variance by iteration. With a ``tolerance`` it
    ends when an iteration changes that by less than this share of it; ``iterations`` entries tell
    that it has not settled.
    """
    data = cut_lineage(
        ratios.where(F.col(value).isNotNull()).select(site, sample, F.col(value).alias("_x"))
    )
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    draws = [
        F.conv(F.substring(hash_order(seed + i, site), 1, 8), 16, 10).cast("double") / 2**32 - 0.5
        for i in range(k)
    ]
    w = cut_lineage(data.select(site).distinct().select(site, F.array(*draws).alias("w")))
    noise, history = 1.0, []
    n_total = data.count()
    types = {c: data.schema[c].dataType.simpleString() for c in (site, sample)}

    def unpack(frame):
        flat = np.stack(frame["_a"].to_numpy())
        full = np.zeros((len(frame), k, k))
        for c, (i, j) in enumerate(pairs):
            full[:, i, j] = full[:, j, i] = flat[:, c]
        return full, np.stack(frame["_b"].to_numpy())

    for _ in range(iterations):
        sums = data.join(broadcast_if_small(w), site).groupBy(sample).agg(
            F.array(*[F.sum(F.col("w")[i] * F.col("w")[j]) for i, j in pairs]).alias("_a"),
            F.array(*[F.sum(F.col("w")[i] * F.col("_x")) for i in range(k)]).alias("_b"),
        )

        def posterior(frames, noise=noise):
            for frame in frames:
                a, b = unpack(frame)
                cov = np.linalg.inv(a + noise * np.eye(k))
                z = np.einsum("bij,bj->bi", cov, b)
                second = noise * cov + z[:, :, None] * z[:, None, :]
                out = frame[[sample]].copy()
                out["z"] = list(z)
                out["zz"] = list(np.stack([second[:, i, j] for i, j in pairs], axis=1))
                yield out

        z = cut_lineage(
            sums.mapInPandas(posterior, f"`{sample}` {types[sample]}, z array<double>, zz array<double>")
        )
        joined = data.join(broadcast_if_small(z), sample)
        sums = joined.groupBy(site).agg(
            F.array(*[F.sum(F.col("zz")[c]) for c in range(len(pairs))]).alias("_a"),
            F.array(*[F.sum(F.col("z")[i] * F.col("_x")) for i in range(k)]).alias("_b"),
            F.sum(F.col("_x") ** 2).alias("_xx"),
        )

        def weights(frames):
            for frame in frames:
                a, b = unpack(frame)
                # sites with fewer entries than factors need the pseudo-inverse
                weight = np.einsum("bij,bj->bi", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
                rest = (
                    frame["_xx"].to_numpy()
                    - 2 * np.einsum("bi,bi->b", weight, b)
                    + np.einsum("bi,bij,bj->b", weight, a, weight)
                )
                out = frame[[site]].copy()
                out["w"], out["_rest"] = list(weight), rest
                yield out

        solved = cut_lineage(
            sums.mapInPandas(weights, f"`{site}` {types[site]}, w array<double>, _rest double")
        )
        w = solved.select(site, "w")
        noise = max(solved.agg(F.sum("_rest")).head()[0] / n_total, 1e-12)
        history.append(noise)
        if settled(history, tolerance):
            break
    return z.select(sample, "z"), w, history


def combat(
    expr: DataFrame,
    batches: DataFrame,
    *,
    batch: str = "batch",
    gene: str = "gene_id",
    cell: str = "cell_id",
    value: str = "value",
    zeros: bool = False,
    max_iter: int = 500,
    tol: float = 1e-8,
) -> DataFrame:
    """Empirical-Bayes correction of batch means and variances.

    Everything the shrinkage needs are counts, means and variances by (gene, batch), so the
    iteration runs on one row per (gene, batch). With ``zeros`` an absent row of a cell in
    ``batches`` is a zero: all cells of a batch count, and ``zero_value`` beside the stored
    rows is what a zero of that gene and batch becomes. A gene of a batch with one cell, or
    without spread, stays as it is. A shrinkage that does not settle raises.
    """
    rows = expr.join(batches.select(cell, batch), cell)
    by_batch = rows.groupBy(gene, batch).agg(
        F.count("*").cast("double").alias("n"),
        F.avg(value).alias("m"),
        F.var_pop(value).alias("v"),
    )
    if zeros:
        sizes = batches.groupBy(batch).agg(F.count("*").cast("double").alias("_all"))
        # every gene in every batch: as many rows as the shrinkage has
        listed = sizes.agg(F.collect_list(F.struct(batch, "_all"))).scalar()
        every = rows.select(gene).distinct().select(gene, F.inline(listed))
        stored = by_batch.withColumnsRenamed({"n": "_n", "m": "_m", "v": "_v"})
        by_batch = every.join(stored, [gene, batch], "left").na.fill(0.0, ["_n", "_m", "_v"])
        share = F.col("_n") / F.col("_all")
        by_batch = by_batch.select(
            gene,
            batch,
            F.col("_all").alias("n"),
            (F.col("_m") * share).alias("m"),
            (F.col("_v") * share + F.col("_m") ** 2 * share * (1 - share)).alias("v"),
        )
    by_batch = cut_lineage(by_batch)
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    pooled = by_batch.groupBy(gene).agg(
        (F.sum(n * m) / F.sum(n)).alias("grand"), F.sqrt(F.sum(n * v) / F.sum(n)).alias("sd")
    )
    scaled = by_batch.join(pooled.where(F.col("sd") > 0), gene).select(
        gene,
        batch,
        "n",
        "grand",
        "sd",
        ((m - F.col("grand")) / F.col("sd")).alias("g_hat"),
        F.when(n > 1, v * n / (n - 1) / F.col("sd") ** 2).alias("d_hat"),
    )
    scaled = cut_lineage(scaled.where(F.col("d_hat").isNotNull()))
    mean, var = F.avg("d_hat"), F.var_samp("d_hat")
    prior = scaled.groupBy(batch).agg(
        F.avg("g_hat").alias("g_bar"),
        F.var_samp("g_hat").alias("t2"),
        ((2 * var + mean**2) / var).alias("a"),
        ((mean * var + mean**3) / var).alias("b"),
    )

    def shrink(frames):
        for frame in frames:
            n, gh, dh, gb, t2, a, b = (
                frame[c].to_numpy(dtype=float) for c in ("n", "g_hat", "d_hat", "g_bar", "t2", "a", "b")
            )
            g, d = gh.copy(), dh.copy()
            for _ in range(max_iter):
                new_g = (t2 * n * gh + d * gb) / (t2 * n + d)
                rest = (n - 1) * dh + n * (gh - new_g) ** 2
                new_d = (0.5 * rest + b) / (n / 2 + a - 1)
                moved = max(
                    np.max(np.abs(new_g - g) / np.maximum(np.abs(g), 1e-12), initial=0.0),
                    np.max(np.abs(new_d - d) / np.maximum(d, 1e-12), initial=0.0),
                )
                g, d = new_g, new_d
                if moved < tol:
                    break
            else:
                raise RuntimeError(f"the shrinkage has not settled after {max_iter} steps")
            out = frame[[gene, batch, "grand", "sd"]].copy()
            out["g_star"], out["d_star"] = g, d
            yield out

    types = {c: scaled.schema[c].dataType.simpleString() for c in (gene, batch)}
    stars = scaled.join(broadcast_if_small(prior), batch).mapInPandas(
        shrink,
        f"`{gene}` {types[gene]}, `{batch}` {types[batch]}, grand double, sd double, "
        "g_star double, d_star double",
    )
    fixed = rows.join(stars, [gene, batch], "left")

    def corrected(x: Column) -> Column:
        z = (x - F.col("grand")) / F.col("sd") - F.col("g_star")
        return F.coalesce(z / F.sqrt("d_star") * F.col("sd") + F.col("grand"), x)

    of_zero = [corrected(F.lit(0.0)).alias("zero_value")] if zeros else []
    return fixed.select(gene, cell, batch, corrected(F.col(value)).alias(value), *of_zero)


def factor_pve(
    obs: DataFrame,
    samples: DataFrame,
    tests: DataFrame,
    *,
    sample: str = "sample",
    test: str = "test",
    g: str = "g",
) -> DataFrame:
    """Share of the variance of the genotype effect and of each factor.

    ``samples`` has ``u``; ``tests`` has ``v``, ``f`` and the precision ``tau``. The total
    includes the noise variance of every sample and test.
    """
    k = len(samples.select("u").head()["u"])
    joined = obs.join(samples.select(sample, "u"), sample).join(tests.select(test, "v", "f", "tau"), test)
    square = F.col(g) ** 2
    terms = [F.sum(square * F.col("f") ** 2)] + [
        F.sum(square * (F.col("u")[i] * F.col("v")[i]) ** 2) for i in range(k)
    ]
    row = joined.agg(*terms, F.sum(1 / F.col("tau"))).head()
    total = sum(row)
    names = ["shared"] + [f"factor_{i}" for i in range(k)]
    return obs.sparkSession.createDataFrame(
        [(name, float(value / total)) for name, value in zip(names, row)], "term string, pve double"
    )


def loading_pve(samples: DataFrame, tests: DataFrame) -> DataFrame:
    """The simpler form without genotypes: sum of squared loadings times squared weights,
    against those of all factors and the noise."""
    k = len(samples.select("u").head()["u"])
    u = samples.agg(F.count("*"), *[F.sum(F.col("u")[i] ** 2) for i in range(k)]).head()
    v = tests.agg(F.sum(1 / F.col("tau")), *[F.sum(F.col("v")[i] ** 2) for i in range(k)]).head()
    parts = [u[i + 1] * v[i + 1] for i in range(k)]
    total = sum(parts) + u[0] * v[0]
    return samples.sparkSession.createDataFrame(
        [(i, float(p / total)) for i, p in enumerate(parts)], "factor int, pve double"
    )
