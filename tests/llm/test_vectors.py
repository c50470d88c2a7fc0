import math
import random

import numpy as np
import pytest

from emberlog.llm import forest
from emberlog.llm.forest import forest_neighbours
from emberlog.llm.maxscore import maxscore_top_k, top_of_shard

SCHEMA = "vec_id long, embedding array<float>, score long, rank string"
SF = "/root/testdata/sf"


def sample(seed, n, width=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)], 1, "x") for i in range(n)]
    same = [0.5] * width
    rows += [(1000 + i, same, 1, "x") for i in range(60)]  # one vector many times
    rows += [(2000, None, 1, "x"), (2050, [None] * width, 1, "x"), (2100, [math.nan] * width, 1, "x")]
    rows += [(2150, [math.inf, *same[1:]], 1, "x"), (None, same, 1, "x"), (2200, same[:3], 1, "x"), (0, same, 1, "x")]
    rows += [(2250, [0.0] * width, 1, "x")]
    return rows


def valid(rows, zero=True):
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            if zero or any(v):
                yield i, [float(np.float32(x)) for x in v]


def as_rows(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("shard_rows,block_queries", [(4096, 256), (40, 3)])
def test_maxscore_is_exact(spark, shard_rows, block_queries):
    rows = sample(1, 300)
    got = as_rows(maxscore_top_k(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows, block_queries=block_queries))
    have = [(i, [math.floor(256 * x) for x in v]) for i, v in valid(rows)]
    want = {}
    for q in {i for i, _ in have if i % 50 == 0}:
        asked = min(v for i, v in have if i == q)
        scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in have if i != q)
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(scores[:5], 1)}
    assert got == want


def test_top_of_shard_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, width = int(rng.integers(1, 200)), int(rng.integers(1, 40))
        values, query = rng.integers(-5, 6, (width, n)), rng.integers(-9, 10, width)
        ids, own = rng.permutation(n), int(rng.integers(0, n))
        want = sorted((-int(query @ values[:, j]), int(i)) for j, i in enumerate(ids) if i != own)[:5]
        assert [(int(s), int(i)) for s, i in top_of_shard(ids, values, query, own, 5)] == want


def test_maxscore_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert maxscore_top_k(df).collect() == [] and forest_neighbours(df).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "x"), (7, [2.0], 1, "x")], SCHEMA)
    assert as_rows(maxscore_top_k(one)) == {(0, 1): (7, 256 * 512)}
    assert as_rows(forest_neighbours(one)) == {(0, 1): (7, 1.0)}
    huge = spark.createDataFrame([(0, [3e8, 1.0], 1, "x"), (7, [-3e4, 0.004], 1, "x")], SCHEMA)
    want = math.floor(256 * float(np.float32(3e8))) * math.floor(-256 * 3e4) + 256
    assert as_rows(maxscore_top_k(huge)) == {(0, 1): (7, want)}


def test_maxscore_bounds_beyond_a_long(spark):
    """Scores fit a long where the bounds of the terms, or components alone, do not."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 if i % 2 else 1e6) for _ in range(16)]) for i in range(0, 300)]
    rows += [(1000, [0.0] * 15 + [1e3]), (1001, [-1e19] + [0.0] * 15), (1003, [1e300, 1.0] + [0.0] * 14)]
    rows += [(1050, [0.0] * 16)]
    got = as_rows(maxscore_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    have = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q in (0, 50, 1000, 1050):
        asked = dict(have)[q]
        scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in have if i != q)
        assert [got[q, r] for r in range(1, 6)] == [(i, clip(-s)) for s, i in scores[:5]]


def test_forest_scores_and_ties(spark):
    rows = sample(2, 400)
    have = list(valid(rows, zero=False))
    got = as_rows(forest_neighbours(spark.createDataFrame(rows, SCHEMA), leaf_rows=40, share=1.0))
    for q in {i for i, _ in have if i % 50 == 0}:
        asked = min(v for i, v in have if i == q)
        pad = lambda v: np.array(v + [0.0] * (6 - len(v)))
        cosine = lambda v: float((pad(v) * pad(asked)).sum() / (np.sqrt((pad(v) ** 2).sum()) * np.sqrt((pad(asked) ** 2).sum())))
        want = sorted({(-cosine(v), i) for i, v in have if i != q})[:5]
        assert [got[q, r][0] for r in range(1, 6)] == [i for _, i in want]
        assert np.allclose([got[q, r][1] for r in range(1, 6)], [-s for s, _ in want], atol=1e-12)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_forest_recall(spark, scale):
    df = spark.read.parquet(f"{SF}{scale}/embeddings.parquet")
    got = as_rows(forest_neighbours(df))
    rows = df.collect()
    ids, unit = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = total = 0
    for j in np.flatnonzero(ids % 50 == 0):
        cosines = unit @ unit[j]
        cosines[j] = -9
        truth = set(ids[np.lexsort((ids, -cosines))[:5]].tolist())
        hits += len(truth & {got[int(ids[j]), r][0] for r in range(1, 6)})
        total += 5
    assert hits / total >= 0.9


def test_forest_budget_follows_structure(spark, monkeypatch):
    """Where rows lie in clusters, the measured share is small and the neighbours are still found."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    vectors = centres[np.arange(4000) % 40] + 0.05 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    shares = []
    measured = forest.share_for
    monkeypatch.setattr(forest, "share_for", lambda *a: shares.append(measured(*a)) or shares[-1])
    got = as_rows(forest_neighbours(df))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        cosines = unit @ unit[q]
        cosines[q] = -9
        hits += len(set(np.argsort(-cosines)[:5].tolist()) & {got[q, r][0] for r in range(1, 6)})
    assert hits >= 0.9 * 400 and shares[0] < 0.25


def test_forest_scores_of_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (50, [1e200, 0.0]), (7, [3e-310, 0.0]), (8, [-1e300, 1e300])]
    got = as_rows(forest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {key: i for key, (i, _) in got.items()} == {(0, 1): 7, (0, 2): 50, (0, 3): 8, (50, 1): 7, (50, 2): 0, (50, 3): 8}
    half = math.sqrt(0.5)
    assert np.allclose([got[0, r][1] for r in (1, 2, 3)] + [got[50, r][1] for r in (1, 2, 3)], [half, half, 0, 1, half, -half])
