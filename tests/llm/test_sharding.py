import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from emberlog.llm.sharding import minimax_cuts, shard_documents


def least_largest(sizes, shards):
    """Smallest capacity for which a greedy walk over the sizes fits, tried one after another."""
    low, high = max(sizes), sum(sizes)

    def needs(capacity):
        used, filled = 1, 0
        for size in sizes:
            if filled + size > capacity:
                used, filled = used + 1, 0
            filled += size
        return used

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(middle) <= shards else (middle + 1, high)
    return high


@pytest.mark.parametrize("seed,n,shards,cells", [(1, 300, 7, 16), (2, 40, 40, 8), (3, 500, 40, 64), (4, 1, 5, 8), (5, 200, 3, 4)])
def test_capacity_is_the_smallest(spark, seed, n, shards, cells):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 16, rng.randint(1, 5000)]) for _ in range(n)]
    ends, total = [], 0
    for size in sizes:
        total += size
        ends.append((total, size))
    capacity, cuts = minimax_cuts(spark.createDataFrame(ends, "end long, group_size long"), shards, cells)
    assert capacity == least_largest(sizes, shards)
    edges = [0, *cuts, total]
    assert len(edges) - 1 <= shards and max(b - a for a, b in zip(edges, edges[1:])) == capacity
    assert set(cuts) <= {end for end, _ in ends}


def test_rows_groups_and_slots(spark):
    rng = random.Random(7)
    texts = [None, "", "hot " * 50, *("x" * rng.randint(1, 900) + "é" for _ in range(60))]
    rows = [(i, rng.choice(texts[:3]) if i % 3 == 0 else rng.choice(texts), i % 5, "z") for i in range(400)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size string")
    got = shard_documents(docs, shards=6, cells=16).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    }
    text_of = {r[0]: r[1] for r in rows}
    shard_of, slots = defaultdict(set), defaultdict(list)
    for r in got:
        data = (text_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, crc32(data), "bytes", None)
        shard_of[text_of[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first, weight = {}, Counter()
    for i, text, *_ in rows:
        first[text] = min(first.get(text, i), i)
        weight[text] += len((text or "").encode()) + 16
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    ordered = sorted(first, key=first.get)
    assert max(load.values()) == least_largest([weight[t] for t in ordered], 6)
    assert [min(shard_of[t]) for t in ordered] == sorted(min(shard_of[t]) for t in ordered)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(docs).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    plan = shard_documents(docs, shards=3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
