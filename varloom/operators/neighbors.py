"""Exact nearest neighbours within groups, kernel weights and neighbour-boosted counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.plans.scale import broadcast_if_small, cut_lineage, ranked, tie_ranks

_GRID_DIMS = 3  # leading dimensions that a grid of blocks is laid over
_TILE, _SIDE = 4 << 20, 8  # most bytes of the vectors of a tile, and tiles of a group up to that size


def standardize_vectors(cells: DataFrame, *, column: str = "pcs") -> DataFrame:
    """Standardise every vector dimension over all cells (population sd)."""
    parts = cells.select(F.posexplode(column).alias("_d", "_x"))
    # one row for each dimension of the vectors
    moments = (
        parts.groupBy("_d").agg(F.avg("_x"), F.stddev_pop("_x")).orderBy("_d").collect()
    )
    mean = F.array(*[F.lit(float(m[1])) for m in moments])
    scale = F.array(*[F.lit(1.0 / m[2] if m[2] else 0.0) for m in moments])
    centred = F.zip_with(column, mean, lambda x, m: x - m)
    return cells.withColumn(column, F.zip_with(centred, scale, lambda x, s: x * s))


def unit_vectors(cells: DataFrame, *, column: str = "pcs") -> DataFrame:
    """Centre each cell's vector and scale it to length one, so that the squared Euclidean
    distance of two cells is 2 - 2r with r their Pearson correlation."""

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    mean = total(F.col(column)) / F.size(column)
    out = cells.withColumn("_mean", mean).withColumn(
        column, F.transform(column, lambda x: x - F.col("_mean"))
    )
    out = out.withColumn("_len", F.sqrt(total(F.transform(column, lambda x: x * x))))
    return out.withColumn(
        column, F.transform(column, lambda x: F.when(F.col("_len") > 0, x / F.col("_len")).otherwise(0.0))
    ).drop("_mean", "_len")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks, summed by dimension to keep small ones exact."""
    square = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d][:, None] - b[:, d][None, :]
        square += gap * gap
    return np.sqrt(square)


def _edges(cells: DataFrame, by: str, column: str, size: int) -> DataFrame:
    """For each group the borders of a grid of about ``size`` cells a spot: as many quantile
    steps on each of the first dimensions as its number of cells asks for."""
    axes = [F.try_element_at(F.col(column), F.lit(d + 1)) for d in range(_GRID_DIMS)]
    most = cells.groupBy(by).count().agg(F.max("count")).head()[0] or 1
    # quantiles finer than the steps of the largest group, so that every group finds its own
    fine = 4 * max(1, math.ceil((most / size) ** (1 / _GRID_DIMS)))
    steps = [i / fine for i in range(1, fine)]
    # quantile sketches merge across tasks, so a hot group is summarised in parallel
    edges = cells.groupBy(by).agg(
        F.count("*").alias("_n"),
        *[F.percentile_approx(a, steps, 10 * fine).alias(f"_q{d}") for d, a in enumerate(axes)],
    )
    edges = edges.withColumn(
        "_steps", F.ceil(F.pow(F.col("_n") / size, F.lit(1.0 / _GRID_DIMS))).cast("int")
    )

    def own(d: int) -> Column:
        place = F.sequence(F.lit(1), F.col("_steps") - 1)
        borders = F.transform(
            place, lambda i: F.col(f"_q{d}")[F.round(i * fine / F.col("_steps")).cast("int") - 1]
        )
        none = F.array().cast("array<double>")
        return F.when((F.col("_steps") > 1) & F.col(f"_q{d}").isNotNull(), borders).otherwise(none)

    return cut_lineage(edges.select(by, *[own(d).alias(f"_e{d}") for d in range(_GRID_DIMS)]))


def _spot(d: int, value: Column) -> Column:
    """The step of dimension d that holds a value; it never falls when the value rises."""
    return F.coalesce(F.size(F.filter(F.col(f"_e{d}"), lambda e: e < value)), F.lit(0))


def _blocks(cells: DataFrame, edges: DataFrame, cell: str, by: str, column: str, size: int) -> DataFrame:
    """Cut each group in blocks of about ``size`` near cells and pack a block in one row."""
    spots = [
        _spot(d, F.try_element_at(F.col(column), F.lit(d + 1))).alias(f"_s{d}") for d in range(_GRID_DIMS)
    ]
    names = [f"_s{d}" for d in range(_GRID_DIMS)]
    placed = cells.join(broadcast_if_small(edges, width=64), by).select(by, cell, column, *spots)
    sizes = placed.groupBy(by, *names).agg(F.count("*").alias("_m"))
    chunk = F.pmod(F.xxhash64(cell), F.ceil(F.col("_m") / size))
    return (
        placed.join(sizes, [by, *names])
        .withColumn("_chunk", chunk)
        .groupBy(by, *names, "_chunk")
        .agg(F.collect_list(F.struct(F.col(cell).alias("id"), F.col(column).alias("v"))).alias("_rows"))
        .withColumn("_block", F.concat_ws("-", *names, "_chunk"))
    )


def _tiles(blocks: DataFrame, by: str, names: list[str], block_size: int) -> DataFrame:
    """Neighbouring blocks side by side in one row: an eighth of the group, or 4 MB if that is less.

    A tile meets every tile of its group at most once, so up to that size each cell moves a
    fixed number of times, whatever the number of cells.
    """
    first = blocks.select(F.size("low").alias("d")).head()
    most = max(1, _TILE // (8 * max(1, first[0] if first else 1)) // block_size)
    order = ranked(blocks.select(by, "block", *names), [*names, "block"], by=[by], out="_rank")
    sizes = blocks.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / _SIDE).alias("_each"))
    placed = order.join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    tile = F.floor((F.col("_rank") - 1) / F.least(F.col("_each"), F.lit(most))).alias("tile")
    return blocks.join(placed.select(by, "block", tile), [by, "block"])


def block_pairs(outline: DataFrame, edges: DataFrame, by: str, others: DataFrame | None = None) -> DataFrame:
    """(by, block, block2): pairs of blocks whose boxes are within the first one's reach. With
    ``others`` the second ones are the blocks of that outline, which may share a name.

    A block is looked for only in the spots of the grid that its box, widened by its reach,
    touches; they are the keys of an equi-join. ``outline`` is (by, block, low, high, reach and
    the block's own spot).
    """
    names = [f"_s{d}" for d in range(_GRID_DIMS)]
    # the small slack keeps a pair whose box distance equals the bound up to rounding
    wide = F.col("reach") * (1 + 1e-9) + 1e-12
    asking = outline.drop(*names).join(broadcast_if_small(edges, width=64), by)
    for d, name in enumerate(names):
        low, high = (F.try_element_at(F.col(c), F.lit(d + 1)) for c in ("low", "high"))
        asking = asking.withColumn(name, F.explode(F.sequence(_spot(d, low - wide), _spot(d, high + wide))))
    other = (outline if others is None else others).select(
        by, *names, F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2")
    )
    zero = F.lit(0.0)
    left = F.zip_with("low2", "high", lambda a, b: F.greatest(a - b, zero))
    right = F.zip_with("low", "high2", lambda a, b: F.greatest(a - b, zero))
    gaps = F.zip_with(left, right, lambda a, b: a * a + b * b)
    box = F.sqrt(F.aggregate(gaps, zero, lambda s, x: s + x))
    return asking.join(other, [by, *names]).where(box <= wide).select(by, "block", "block2")


def knn(
    cells: DataFrame,
    k: int,
    *,
    by: str = "individual_id",
    cell: str = "cell_id",
    column: str = "pcs",
    metric: str = "euclidean",
    standardize: bool = True,
    block_size: int = 1024,
) -> DataFrame:
    """Edges to the ``k`` nearest other cells of the same group, nearest first.

    Blocks of near cells are compared block by block. Each block first searches itself,
    which bounds the distance of every cell's k-th neighbour; another block is visited only
    when the boxes of the two blocks are closer than that bound. Such blocks are found by the
    spots of a grid that the widened box touches, not by pairing all blocks. The result is
    exact, and only candidates within the bound leave a task. Blocks travel in tiles of bounded
    size, and a task holds two tiles at a time.
    """
    ready = cells.select(cell, by, F.col(column).cast("array<double>").alias(column))
    if metric == "pearson":
        ready = unit_vectors(ready, column=column)
    elif standardize:
        ready = standardize_vectors(ready, column=column)
    id_type = ready.schema[cell].dataType.simpleString()
    by_type = ready.schema[by].dataType.simpleString()
    edges = _edges(ready, by, column, block_size)
    packed = _blocks(ready, edges, cell, by, column, block_size)
    names = [f"_s{d}" for d in range(_GRID_DIMS)]

    def bound(frames):
        for frame in frames:
            out = []
            spots = frame[names].to_numpy().tolist()
            for group, block, rows, spot in zip(frame[by], frame["_block"], frame["_rows"], spots):
                ids = [r["id"] for r in rows]
                x = np.array([r["v"] for r in rows], dtype=float)
                limit = np.full(len(x), np.inf)
                if len(x) > k:
                    d = _distances(x, x)
                    np.fill_diagonal(d, np.inf)
                    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
                out.append(
                    (group, block, ids, x.ravel(), limit, x.min(0), x.max(0), limit.max(), *spot)
                )
            columns = [by, "block", "ids", "flat", "limits", "low", "high", "reach", *names]
            yield pd.DataFrame(out, columns=columns)

    blocks = cut_lineage(
        packed.mapInPandas(
            bound,
            f"`{by}` {by_type}, block string, ids array<{id_type}>, flat array<double>, "
            "limits array<double>, low array<double>, high array<double>, reach double, "
            + ", ".join(f"{c} int" for c in names),
        )
    )
    placed = cut_lineage(_tiles(blocks, by, names, block_size), replaces=blocks)
    parts = ("ids", "flat", "limits", "low", "high")
    listed = F.collect_list(F.struct(*parts, "reach", F.size("ids").alias("n")))
    tiles = placed.groupBy(by, "tile").agg(listed.alias("_b"))
    tiles = cut_lineage(
        tiles.select(
            by,
            F.col("tile").cast("string").alias("block"),
            *[F.flatten(F.col(f"_b.{c}")).alias(c) for c in parts],
            F.col("_b.reach").alias("reaches"),
            F.col("_b.n").alias("sizes"),
        )
    )
    spots = placed.withColumn("block", F.col("tile").cast("string"))

    def ends(f, c):
        return F.array(*[f(F.col(c)[d]) for d in range(width)])

    first = placed.select(F.size("low")).head()
    width = first[0] if first else 0
    outline = spots.groupBy(by, "block").agg(
        ends(F.min, "low").alias("low"), ends(F.max, "high").alias("high"), F.max("reach").alias("reach")
    )
    others = spots.select(by, "block", "low", "high", *names)
    pairs = block_pairs(outline, edges, by, others).distinct()
    sources = tiles.select(by, "block", "ids", "flat", "limits", "low", "high", "reaches", "sizes")
    targets = tiles.select(by, *[F.col(c).alias(f"{c}2") for c in ("block", "ids", "flat", "low", "high", "sizes")])
    work = pairs.join(sources, [by, "block"]).join(targets, [by, "block2"])

    def search(frames):
        for frame in frames:
            parts = []
            for row in frame.itertuples(index=False):
                record = dict(zip(frame.columns, row))
                ids, ids2 = np.asarray(record["ids"]), np.asarray(record["ids2"])
                limits = np.asarray(record["limits"]) * (1 + 1e-9) + 1e-12
                x, y = np.reshape(record["flat"], (len(ids), -1)), np.reshape(record["flat2"], (len(ids2), -1))
                low, high, low2, high2 = (
                    np.reshape(record[c], (-1, x.shape[1])) for c in ("low", "high", "low2", "high2")
                )
                owner2 = np.repeat(np.arange(len(low2)), record["sizes2"])
                ends = np.cumsum(record["sizes"])
                for n, (end, size) in enumerate(zip(ends, record["sizes"])):
                    gap = np.maximum(low2 - high[n], 0) ** 2 + np.maximum(low[n] - high2, 0) ** 2
                    near = ~(np.sqrt(gap.sum(1)) > record["reaches"][n] * (1 + 1e-9) + 1e-12)
                    at = np.flatnonzero(near[owner2])
                    if not len(at):
                        continue
                    own = np.arange(end - size, end)
                    d = _distances(x[own], y[at])
                    if record["block"] == record["block2"]:
                        d[own[:, None] == at[None, :]] = np.inf
                    keep = np.minimum(k, len(at))
                    kth = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    limit = np.minimum(kth, limits[own])
                    i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                    parts.append(
                        pd.DataFrame(
                            {by: record[by], cell: ids[own[i]], "neighbor_id": ids2[at[j]], "distance": d[i, j]}
                        )
                    )
            if parts:
                yield pd.concat(parts, ignore_index=True)

    found = work.mapInPandas(
        search,
        f"`{by}` {by_type}, `{cell}` {id_type}, neighbor_id {id_type}, distance double",
    )
    nearest = Window.partitionBy(by, cell).orderBy("distance", "neighbor_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select(by, cell, "neighbor_id", "rank", "distance")
    )


def median_of(df: DataFrame, column: str) -> float:
    """Exact median over all rows, by ranks instead of one sorted group."""
    ranks = cut_lineage(tie_ranks(df, column))
    n = ranks.agg(F.sum("n")).head()[0]
    low, high = (n + 1) // 2, (n + 2) // 2
    spots = ranks.where((F.col("lo") <= high) & (F.col("hi") >= low)).select(column, "lo", "hi")
    rows = spots.collect()  # one or two rows
    first = next(r[column] for r in rows if r["lo"] <= low <= r["hi"])
    second = next(r[column] for r in rows if r["lo"] <= high <= r["hi"])
    return (first + second) / 2


def knn_weighted(
    cells: DataFrame,
    k: int,
    *,
    width: str = "adaptive",
    by: str = "individual_id",
    cell: str = "cell_id",
    column: str = "pcs",
    metric: str = "euclidean",
    standardize: bool = True,
    block_size: int = 1024,
) -> DataFrame:
    """3k neighbours weighted by exp(-(d / w)^2). The width is the distance to the k-th
    neighbour of the cell, or the median of those distances over all cells."""
    edges = cut_lineage(
        knn(
            cells, 3 * k, by=by, cell=cell, column=column, metric=metric,
            standardize=standardize, block_size=block_size,
        )
    )
    kth = edges.where(F.col("rank") == k).select(by, cell, F.col("distance").alias("width"))
    if width == "median":
        edges = edges.withColumn("width", F.lit(median_of(kth, "width")))
    elif width == "adaptive":
        edges = edges.join(kth, [by, cell])
    else:
        raise ValueError(f"unknown width {width}")
    ratio = F.col("distance") / F.col("width")
    weight = F.when(F.col("width") > 0, F.exp(-ratio * ratio)).otherwise(
        (F.col("distance") == 0).cast("double")
    )
    return edges.withColumn("weight", weight)


def knn_boost(
    counts: DataFrame,
    edges: DataFrame,
    *,
    weighted: bool = False,
    cell: str = "cell_id",
    neighbor: str = "neighbor_id",
    gene: str = "gene_id",
    value: str = "count",
) -> DataFrame:
    """Own counts plus those of the neighbours; the weighted form divides by 1 + sum(w)."""
    weight = F.col("weight") if weighted else F.lit(1.0)
    out = edges.select(cell, neighbor, weight.alias("_w"))
    own = counts.select(cell).distinct().select(
        cell, F.col(cell).alias(neighbor), F.lit(1.0).alias("_w")
    )
    links = out.unionByName(own)
    if weighted:
        totals = links.groupBy(cell).agg(F.sum("_w").alias("_total"))
        links = links.join(totals, cell).select(
            cell, neighbor, (F.col("_w") / F.col("_total")).alias("_w")
        )
    given = counts.select(F.col(cell).alias(neighbor), gene, value)
    return (
        links.join(given, neighbor)
        .groupBy(cell, gene)
        .agg(F.sum(F.col("_w") * F.col(value)).alias(value))
    )
