"""Exact top-k search against all inner products in Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

import matchspark.llm.maxscore as ms

KIND = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    ints = lambda v: [math.floor(1024 * Fraction(x)) for x in np.float32(v).tolist()] if len(v) else []
    able = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in able:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, w in asks.items():
        best = sorted((-max(ms.LEAST, min(ms.MOST, sum(a * b for a, b in zip(w, v)))), i) for i, v in able if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, ms.maxscore_search(df, **kw).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD", 16), ("SEED_ROWS", 40), ("QUERY_BYTES", 2000), ("GROUP", 3)):
        monkeypatch.setattr(ms, name, value)


@pytest.mark.parametrize("k", [1, 10])
def test_random_vectors_with_ties(spark, small, k):
    rng = np.random.default_rng(3)
    vecs = rng.normal(0, 0.12, (400, 24)).astype(np.float32)
    vecs[200:260] = vecs[7]
    vecs[:, 5] = 0
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(400), vecs)]
    assert got(spark.createDataFrame(rows, KIND).repartition(3), k=k, every=9) == brute(rows, k, 9)


def test_odd_vectors(spark, small):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, int(rng.integers(0, 6))).astype(np.float32).tolist()) for i in range(120)]
    rows += [(10, None), (20, [1.0, None]), (30, [math.nan]), (40, [math.inf, 1.0]), (None, [1.0, 2.0]), (7, [0.25] * 5), (7, [0.25] * 5), (-10, [-0.5] * 5), (0, [0.1]), (0, [0.1])]
    assert got(spark.createDataFrame(rows, KIND).repartition(4), every=10) == brute(rows, 10, 10)


def test_scores_beyond_doubles_and_longs(spark, small):
    rows = [(i, [float(3 ** (i % 20)), 1.0, -float(2 ** (i % 60))]) for i in range(90)] + [(200, [3e38, 1.0, 1.0]), (210, [-3e38, 0.0, 1.0])]
    assert got(spark.createDataFrame(rows, KIND).repartition(3), every=10) == brute(rows, 10, 10)


def test_few_candidates_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0], 5, "a"), (1, [2.0], 6, "b")], KIND + ", score int, rank string")
    assert got(df) == [(0, 1, 1, 2048 * 1024)]
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 1")) == [] and got(df.where("vec_id = 0")) == []


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(df, every=10) == brute([(r.vec_id, r.embedding) for r in df.collect()], 10, 10)
