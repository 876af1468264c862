"""Rows that must not move or be made: plans and results of the wide operators."""

import math
import re
import time
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from varloom.functions.columns import correlation
from varloom.operators import aggregates as A
from varloom.operators import joins as J
from varloom.operators import neighbors as K
from varloom.plans import scale
from varloom.plans.factor_input import factor_observations


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_correlation_without_spread(spark):
    rows = [("a", 3, 5), ("b", 7, 5), ("c", 9, 5)]
    table = spark.createDataFrame(rows, "cell_type string, n_cells long, n_egenes long")
    got = A.egene_cell_correlation(table).head()
    assert math.isnan(got["r"]) and got["n_groups"] == 3
    mixed = [(1.0, 2.0), (2.0, 1.0), (4.0, None), (None, 3.0), (5.0, 7.0)]
    df = spark.createDataFrame(mixed, "x double, y double")
    r = df.agg(correlation("x", "y")).head()[0]
    assert np.isclose(r, np.corrcoef([1, 2, 5], [2, 1, 7])[0, 1])
    assert df.limit(1).agg(correlation("x", "y")).head()[0] is None


def genotypes(spark, rng, donors=4, variants=6):
    rows = [(v, d, None if rng.random() < 0.1 else float(rng.integers(0, 3))) for v in range(variants) for d in range(donors)]
    return rows, spark.createDataFrame(rows, "variant_id int, individual_id int, dosage double")


def test_expanded_cells_carry_columns(spark):
    rng = np.random.default_rng(1)
    rows, genotype = genotypes(spark, rng)
    # a cell that comes twice, one without a known donor
    cells = [(c, int(rng.integers(0, 4)), "ab"[c % 2]) for c in range(30)] + [(3, 1, "a"), (99, 77, "b")]
    table = spark.createDataFrame(cells, "cell_id int, individual_id int, cell_type string")
    pairs = spark.createDataFrame([(v,) for v in range(0, 6, 2)], "variant_id int")
    out = J.expand_genotype_to_cells(pairs, genotype, table, also=["cell_type"])
    assert "Exchange hashpartitioning(cell_id" not in plan(out.groupBy("variant_id", "cell_type").count())
    key = lambda r: (r[0], r[1], r[2], r[3], -1.0 if r[4] is None else r[4])
    want = [(c, t, d, v, x) for c, d, t in cells for v, i, x in rows if i == d and v % 2 == 0]
    got = [tuple(r) for r in out.select("cell_id", "cell_type", "individual_id", "variant_id", "dosage").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_standardized_rows_are_rounded_by_donor(spark):
    """A value is rounded once for each donor and variant; cells times variants are only joined."""
    _, genotype = genotypes(spark, np.random.default_rng(7))
    cells = spark.createDataFrame([(c, c % 4) for c in range(30)], "cell_id int, individual_id int")
    pairs = spark.createDataFrame([(v,) for v in range(6)], "variant_id int")
    out = J.standardized_genotype(pairs, genotype, cells, digits=2)
    assert "round(" not in plan(out)
    plain = J.standardized_genotype(pairs, genotype, cells).withColumn("dosage", F.round("dosage", 2))
    names = ["cell_id", "individual_id", "variant_id", "dosage"]
    got, want = (sorted(tuple(r) for r in t.select(*names).collect()) for t in (out, plain))
    assert got == want and len(got) > 100


def test_cells_of_a_donor_are_written_in_runs(spark):
    """Rows come variant by variant for a block of cells, so that written columns stay equal over
    long runs; cells that are NULL or come twice keep their rows."""
    cells = spark.range(6000).selectExpr("id AS cell_id", "CAST(id % 3 AS INT) AS individual_id")
    more = spark.createDataFrame([(None, 1), (None, 1), (5, 2), (7, None)], "cell_id long, individual_id int")
    genotype = spark.range(150).selectExpr("CAST(id % 50 AS INT) AS variant_id", "CAST(id % 3 AS INT) AS individual_id", "CAST(id % 4 AS DOUBLE) AS dosage")
    genotype = genotype.union(genotype.where("variant_id = 9 AND individual_id = 0"))  # a genotype that comes twice
    both = cells.union(more)
    out = J.expand_genotype_to_cells(genotype.select("variant_id"), genotype, both)
    names = ["individual_id", "cell_id", "variant_id", "dosage"]
    assert out.columns == names
    rows = [tuple(r) for r in out.collect()]
    turns = sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    assert turns < len(rows) / 20
    want = [tuple(r) for r in both.join(genotype, "individual_id").select(names).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_factor_observations_look_genes_up_by_block(spark):
    """Which cells lack a gene is told once by block and gene, not by test and cell; repeated rows of
    cells, values and genotypes, and NULLs, count as in a plain join."""
    rng = np.random.default_rng(5)
    _, genotype = genotypes(spark, rng)
    genotype = genotype.union(genotype.where("variant_id = 2 AND individual_id = 1"))
    own = [(int(c), int(rng.integers(0, 4))) for c in range(40)] + [(3, 1), (None, 2), (41, None), (42, 9)]
    cells = spark.createDataFrame(own, "cell_id int, individual_id int")
    e = [(f"g{g}", int(c), float(rng.integers(1, 9))) for c in range(44) for g in range(4) if rng.random() < 0.3]
    e += [e[0], (e[1][0], e[1][1], None), (None, 5, 1.0), ("g1", None, 2.0), ("g9", 6, None)]
    expression = spark.createDataFrame(e, "gene_id string, cell_id int, value double")
    pairs = [("g0", 1), ("g0", 2), ("g3", 1), ("g2", 2), ("g9", 1), (None, 1), ("g0", 1)]
    pairs = spark.createDataFrame(pairs, "gene_id string, variant_id int")
    out = factor_observations(pairs, expression, genotype, cells)
    text = plan(out)
    assert "posexplode" in text and "array_contains" not in text
    known = expression.join(cells.select("cell_id"), "cell_id", "left_semi")
    means = known.groupBy("gene_id").agg((F.sum("value") / len(own)).alias("m"))
    g = J.standardized_donor_genotype(pairs, genotype, cells).where("dosage IS NOT NULL")
    grid = pairs.distinct().join(means, "gene_id").join(g, "variant_id").join(cells, "individual_id")
    rows = grid.join(known.withColumn("there", F.lit(1)), ["gene_id", "cell_id"], "left")
    want = rows.select(F.concat_ws(":", "gene_id", "variant_id"), "cell_id", "dosage", F.coalesce("value", F.lit(0.0)) - F.col("m"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = (sorted((tuple(r) for r in t.collect()), key=key) for t in (out, want))
    assert len(got) == len(want) > 100
    assert [r[:2] for r in got] == [r[:2] for r in want]
    numbers = lambda rows: np.array([[np.nan if x is None else x for x in r[2:]] for r in rows])
    assert np.allclose(numbers(got), numbers(want), equal_nan=True)


def test_factor_observations_stay_with_the_cells(spark):
    rng = np.random.default_rng(2)
    rows, genotype = genotypes(spark, rng)
    cells = pd.DataFrame({"cell_id": np.arange(40), "individual_id": rng.integers(0, 4, 40)})
    e = [(f"g{g}", int(c), float(rng.integers(1, 9))) for c in range(40) for g in range(5) if rng.random() < 0.4]
    expression = spark.createDataFrame(e, "gene_id string, cell_id int, value double")
    pairs = [("g0", 1), ("g0", 2), ("g3", 1), ("g4", 5), ("none", 1)]
    out = factor_observations(
        spark.createDataFrame(pairs, "gene_id string, variant_id int"),
        expression,
        genotype,
        spark.createDataFrame(cells),
    )
    assert not re.search(r"hashpartitioning\(gene_id#\d+, cell_id#", plan(out))
    assert not re.search(r"hashpartitioning\(cell_id#\d+\S*, gene_id#", plan(out))
    donor = dict(zip(cells.cell_id.tolist(), cells.individual_id.tolist()))
    value = {(g, c): x for g, c, x in e}
    known = {(v, d): x for v, d, x in rows if x is not None}
    want = []
    for g, v in pairs[:4]:
        mean = sum(x for (h, _), x in value.items() if h == g) / 40
        dose = np.array([known[v, donor[c]] for c in range(40) if (v, donor[c]) in known])
        for c in range(40):
            if (v, donor[c]) in known:
                want.append((f"{g}:{v}", c, (known[v, donor[c]] - dose.mean()) / dose.std(), value.get((g, c), 0.0) - mean))
    got = sorted(tuple(r) for r in out.select("test", "sample", "g", "y").collect())
    want.sort()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_neighbours_in_many_tiles(spark, monkeypatch):
    """Blocks travel in a bounded number of tiles, and the neighbours stay exact."""
    rng = np.random.default_rng(3)
    n, k = 900, 4
    x = np.round(rng.normal(size=(n, 5)), 2)  # rounded, so that distances tie
    group = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 4, n))
    rows = [(i, int(group[i]), x[i].tolist()) for i in range(n)]
    cells = spark.createDataFrame(rows, "cell_id int, individual_id int, pcs array<double>")
    tiles = []
    placed = K._tiles

    def kept(*args):
        out = placed(*args)
        tiles.extend(tuple(r) for r in out.groupBy("individual_id").agg(F.count_distinct("tile")).collect())
        return out

    monkeypatch.setattr(K, "_tiles", kept)
    found = K.knn(cells, k, standardize=False, block_size=16).collect()
    got = {(r["cell_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in found}
    want = {}
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((d[j], j) for j in range(n) if j != i and group[j] == group[i])[:k]
        want |= {(i, rank): (j, dist) for rank, (dist, j) in enumerate(near, 1)}
    assert got.keys() == want.keys()
    assert np.allclose([got[a][1] for a in want], [want[a][1] for a in want])
    assert sum(got[a][0] == want[a][0] for a in want) >= 0.99 * len(want)  # last digits may turn ties
    assert dict(tiles)[0] > 1 and max(m for _, m in tiles) <= K._SIDE


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {Path(x).name for x in disk.getAllFiles().mkString(",").split(",") if "shuffle_" in x}

    before = shuffles()
    rows = spark.range(1000).repartition(7, "id")
    scale.cut_lineage(rows)
    one, two = scale.cut_in_parts(rows.selectExpr("id", "id % 2 AS part"), "part", [1, 5])
    for _ in range(100):  # they are deleted in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    assert (one.count(), one.columns, two.count()) == (500, ["id"], 0)
