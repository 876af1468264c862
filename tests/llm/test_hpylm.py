"""Counts against plain Python, the sampler against exact sums, and held-out perplexity."""

import math
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from varloom.llm import hpylm
from varloom.llm.queries import QUERIES
from varloom.plans.scale import checkpoint_folder


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_counts_and_held_out_perplexity(spark, scale):
    folder = f"/root/testdata/{scale}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    count = Counter()
    for d in docs:
        if not held[d.doc_id]:
            count.update([*brute.words(d.text), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in QUERIES["op6_hpylm"](spark, folder).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, own = got[d.doc_id], [*brute.words(d.text), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d.doc_id], len(own), n)
        assert r.n_known == sum(count[w] > 0 for w in own)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens


def test_tokens_and_runs_of_bytes():
    texts = ["Ab  c", "", None, "\t\nxÉ ", "z" * 9, "c ab"]
    every, bounds, _, _, _ = hpylm.tokens(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(brute.words(t)) + 1 for t in texts]
    words = hpylm.Words(pa.array(texts), np.array([1, 1, 0, 1, 1, 0]))
    spelt = {
        words.symbols[a:b].tobytes(): (int(k), n)
        for k, n, a, b in zip(words.keys, words.count.tolist(), words.bounds[:-1], words.bounds[1:])
    }
    want = {b"ab ": 1, b"c ": 1, "xÉ ".encode(): 1, b"z" * 9 + b" ": 1, b"\n": 4}
    assert {w: n for w, (_, n) in spelt.items()} == want
    order = [w.encode() + b" " for t in texts for w in brute.words(t)]
    assert [int(x) for x in every if x != hpylm.END_TOKEN] == [spelt[w][0] for w in order]
    k = 0
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        padded = b"\n" * 5 + words.symbols[a:b].tobytes()
        for i in range(b - a):
            assert int(words.grams[k]) == int.from_bytes(padded[i : i + 6], "big")
            k += 1


def test_probabilities_of_all_next_bytes_sum_to_one():
    r = np.random.default_rng(2)
    text = bytes(r.choice([97, 98, 99, 32], 4000))
    seen = Counter(text[i : i + 6] for i in range(len(text) - 5))
    contexts = sorted({x[:5] for x in seen})[:40] + [b"zzzaa"]
    every = sorted({int.from_bytes(c + bytes([b]), "big") for c in contexts for b in range(256)} | {int.from_bytes(x, "big") for x in seen})
    keys = np.array(every, np.uint64)
    count = np.array([seen.get(k.to_bytes(6, "big"), 0) for k in every])
    base = np.full((256, 256), 1 / 256)
    chance = hpylm.Restaurants(keys, count, base, hpylm.Settings()).run()
    by = Counter()
    for k, p in zip(every, chance):
        if k.to_bytes(6, "big")[:5] in contexts:
            by[k >> 8] += p
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in by.values())


def exact_mean(c, others, p, d, s):
    stirling = hpylm.log_stirling(d, c)[c]
    weight, rise = [], 0.0
    for t in range(1, c + 1):
        rise += math.log((s + d * (others + t - 1)) * p)
        weight.append(rise + stirling[t])
    weight = np.exp(np.array(weight) - max(weight))
    return float((weight * np.arange(1, c + 1)).sum() / weight.sum())


@pytest.mark.parametrize("c", [2, 7, 32, 60, 200])
def test_tables_follow_the_seating_distribution(c):
    n, random = 6000, np.random.default_rng(c)
    for others, p in ((0, 0.1), (30, 0.02)):
        got = hpylm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), 0.5, 1.0, random)
        want = exact_mean(c, others, p, 0.5, 1.0)
        assert abs(got.mean() - want) < (0.06 if c <= 32 else 0.15) * want


def test_nulls_empty_long_repeats_and_clashing_names(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "the cat " * 20000), (3, "The cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS key", "2 AS trained")
    out = hpylm.score(df, key="doc_id", trained=F.col("doc_id") < 3, block_bytes=1000).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 40001), (3, 3)]
    assert {r.train_tokens for r in out} == {40003} and all(r.score < 0 for r in out)
    assert hpylm.score(df.limit(0), key="doc_id", trained=F.lit(True)).count() == 0
    none = hpylm.score(df, key="doc_id", trained=F.lit(False)).collect()
    assert {r.n_known for r in none} == {0}


def test_words_before_count_and_blocks_do_not(spark):
    r = np.random.default_rng(5)
    follow = {w: r.choice(40, 3, replace=False) for w in range(40)}
    rows, w = [], 0
    for i in range(300):
        own = []
        for _ in range(30):
            w = int(r.choice(follow[w]))
            own.append(f"w{w}")
        rows.append((i, " ".join(own)))
    rows += [(i + 1000, " ".join(r.permutation(t.split()))) for i, t in rows[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = (F.col("doc_id") >= 60) & (F.col("doc_id") < 1000)
    one, two = (
        {x.doc_id: x for x in hpylm.score(df, key="doc_id", trained=trained, block_bytes=b).collect()}
        for b in (1 << 20, 2000)
    )
    above = [one[i].score - one[i + 1000].score for i in range(60)]
    assert min(above) > 0
    # a tenth of the words can follow a word, so that half the digits of 1 in 40 are gained
    assert sum(one[i].score - one[i].base_score for i in range(60)) > 60 * 30 * 0.5
    assert all(math.isclose(one[i].score, two[i].score, rel_tol=1e-4) for i in one)


def test_packed_numbers_and_places_come_back():
    r = np.random.default_rng(3)
    for kind, most in (("<i4", 1 << 31), ("<i8", 1 << 62), ("<u8", 1 << 63)):
        for n in (0, 1, 500):
            x = r.integers(0, most, n).astype(kind)
            assert (hpylm.unplanes(hpylm.planes(x, kind), kind) == x).all()
    for at in ([], [-1, -1], [0, 1, 5], [-1, 3, -1, 4, 900_000, -1]):
        assert hpylm.linked(hpylm.links(np.array(at, np.int64))).tolist() == at


def test_only_the_scores_stay_on_disk(spark):
    folder = Path(urlparse(checkpoint_folder(spark)).path)
    before = set(folder.rglob("*.parquet"))
    df = spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(50)], "doc_id long, text string")
    hpylm.score(df, key="doc_id", trained=F.col("doc_id") > 5, block_bytes=200)
    left = set(folder.rglob("*.parquet")) - before
    assert len({p.parent for p in left}) == 1
