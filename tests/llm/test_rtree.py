import random

import duckdb
import numpy as np
import pytest

from emberlog.llm.catalog import op13_rtree_negatives
from emberlog.llm.rtree import HARD_NEGATIVES_SQL, HIGHEST, LOWEST, Search, Tree, hard_negatives, rotated_label
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, every=100, positives=5, negatives=10, window=(30, 90)):
    kept = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, tuple(int(np.floor(256 * x)) for x in vec), label))
    out = []
    for anchor in sorted({r[0] for r in kept if r[0] % every == 0}):
        vec, label = min((r[1], r[2]) for r in kept if r[0] == anchor)
        scored = sorted((-sum(a * b for a, b in zip(vec, r[1])), r[0], r[2]) for r in kept if r[0] != anchor)
        for s, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:negatives]
            out += [(anchor, positive, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.1")])
def test_given_tables_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert rows_of(op13_rtree_negatives(spark, folder)) == sorted(con.execute(HARD_NEGATIVES_SQL).fetchall())


@pytest.mark.parametrize("seed,n,shard,leaf,most", [(1, 300, 40, 4, 64), (2, 400, 7, 3, 5)])
def test_small_shards_ties_and_a_hot_vector(spark, seed, n, shard, leaf, most):
    rng = random.Random(seed)
    point = lambda: [rng.choice([-0.5, 0.25, 0.1, 0.0]) for _ in range(rng.choice([3, 3, 3, 2]))]
    rows = [(i, [0.5, 0.5, 0.5] if rng.random() < 0.33 else point(), rng.randint(0, 3)) for i in range(n)]
    rows += rng.sample(rows, n // 10)  # repeated rows
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), rotated_label, every=20, shard_rows=shard, leaf_rows=leaf, max_shards=most)
    assert rows_of(got) == by_hand(rows, every=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i / 50, 1.0], i % 2) for i in range(1, 40)] + [(0, [1.0, 1.0], 0), (100, None, 1), (200, [], 1), (None, [1.0], 1)]
    rows += [(300, [nan, 1.0], 1), (400, [inf], 0), (500, [None], 0), (600, [1.0, 1.0], None), (700, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS shard", "2 AS kind", "3 AS score", "4 AS vec", "5 AS _row")
    assert rows_of(hard_negatives(df, rotated_label, shard_rows=10, leaf_rows=3)) == by_hand(rows)
    assert hard_negatives(df.limit(0)).collect() == []
    assert hard_negatives(df.filter("label IS NULL")).collect() == []


def test_boxes_bound_every_product_and_leaves_are_pruned():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 16))
    values = (centres[rng.integers(0, 40, 4000)] + rng.integers(-4, 5, (4000, 16))).astype(np.int64)
    tree = Tree.pack(np.arange(4000), np.zeros(4000, np.int64), values, 50)
    assert sorted(tree.ids.tolist()) == list(range(4000))
    queries = centres[:5]
    bounds = tree.bounds(queries)
    scores = tree.values @ queries.T
    for leaf in range(80):
        low, high = bounds[0]
        own = scores[leaf * 50 : (leaf + 1) * 50]
        assert (own >= low[:, leaf]).all() and (own <= high[:, leaf]).all()
    for i, query in enumerate(queries):
        search = Search(-1, 0, np.array([LOWEST]), np.array([HIGHEST]), np.array([LOWEST]), 10, True)
        opened = search.run(tree, query, [(low[i], high[i]) for low, high in bounds])
        assert search.held[0][0].tolist() == sorted(scores[:, i].tolist(), reverse=True)[:10]
        assert opened <= 40  # half of the leaves at most
