import hashlib
import random
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlog.llm.merkle import LOWER, UPPER, manifest_report, merkle_manifest, node_position
from emberlog.llm.merkle_sql import manifest_sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        run = level[start : start + 16]
        out.append(("".join(run[: i - start]), "".join(run[i - start + 1 :])))
        i //= 16
    return out


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        ordered = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[source] = ordered, levels_of([leaf_of(r) for r in ordered])
    head = levels_of([trees[s][1][-1][0] for s in sources])
    out = []
    for n, source in enumerate(sources):
        ordered, tree = trees[source]
        for i, row in enumerate(ordered):
            path = siblings(tree, i) + siblings(head, n)
            folded = leaf_of(row)
            if row[0] is not None and row[4] is not None and crc32(str(row[0]).encode()) % 5 == 0:
                folded = leaf_of((*row[:4], row[4].translate(str.maketrans(UPPER, LOWER))))
            for before, after in path:
                folded = h(before + folded + after)
            root = head[-1][0]
            out.append((row[0], leaf_of(row), tree[-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def postorder(leaves):
    """(level, index) of every node in the order of a builder that takes leaf after leaf."""
    out = []
    top = 0
    while 16**top < leaves:
        top += 1
    for leaf in range(leaves):
        out.append((0, leaf))
        for level in range(1, top + 1):
            if (leaf + 1) % 16**level == 0 or leaf + 1 == leaves:
                out.append((level, leaf // 16**level))
    return out


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 255, 256, 257, 4097, 5000])
def test_positions_are_those_of_an_append_log(spark, leaves):
    order = postorder(leaves)
    rows = spark.createDataFrame([(level, index, place) for place, (level, index) in enumerate(order)], "l int, i long, p long")
    found = None
    for level in range(5):
        at = rows.filter(F.col("l") == level).select("p", node_position(level, F.col("i"), F.lit(leaves).cast("long"), 5).alias("q"))
        found = at if found is None else found.unionByName(at)
    assert found.count() == len(order) and found.filter("p <> q").isEmpty()


@pytest.mark.parametrize("seed,n,hot", [(1, 40, 2), (3, 6000, 20)])
def test_manifest_equals_the_one_by_hand(spark, seed, n, hot):
    rng = random.Random(seed)
    sources = [None, "", "a", "hot", "é", "z", "Z"]
    rows = [
        (
            rng.choice([None, *range(n // 2)]), rng.choices(sources, [1, 1, 3, hot, 2, 0.1, 1])[0], rng.choice([None, "en", ""]),
            rng.choice([None, 5, -1]), rng.choice([None, "", "Abc", "xyz é", "Straße ÀB" * rng.randint(1, 5)]),
        )
        for _ in range(n)
    ]
    got = sorted(map(tuple, manifest_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == by_hand(rows)


def test_sizes_around_full_runs_and_blocks_and_many_sources(spark):
    """One source of each size, and 300 small ones, so that the tree of sources has three levels too."""
    rows, i = [], 0
    for leaves in [1, 16, 17, 256, 257, 4096, 4097, *[1, 2] * 150]:
        source = f"s{leaves}" if leaves > 2 else f"small{i}"
        for _ in range(leaves):
            rows.append((i, source, "en", 3, f"Text {i}"))
            i += 1
    got = sorted(map(tuple, manifest_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == by_hand(rows)


def test_places_are_gapless_below_the_nodes_above(spark):
    rows = [(i, "s", None, None, "T") for i in range(600)]
    got = [r.position for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()]
    assert got == [place for place, (level, _) in enumerate(postorder(600)) if level == 0]


def test_empty_repeated_long_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest_report(empty).collect() == []
    long = [(1, "s", "en", 9, "Wort " * 400_000), (1, "s", "en", 9, "Wort " * 400_000), (2, None, None, None, None)]
    df = spark.createDataFrame(long, SCHEMA).selectExpr(
        "*", "1 AS tree", "2 AS digest", "3 AS leaf", "4 AS position", "5 AS path", "6 AS block", "7 AS _row", "8 AS leaves"
    )
    assert sorted(map(tuple, manifest_report(df).collect()), key=str) == by_hand(long)


def test_sql_twin_agrees_by_hand():
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "b", "é"]), rng.choice([None, "en"]), rng.choice([None, 4]), rng.choice([None, "", "Ab É"])) for i in range(800)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(manifest_sql()).fetchall(), key=str) == by_hand(rows)
