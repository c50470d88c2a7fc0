import hashlib
import random

import numpy as np
import pytest

from emberlog.llm.substring import PhraseAutomaton, anchored_runs, remove_repeats, repeat_report

SCHEMA = "doc_id long, text string, text_key string, row int"


def brute(rows, length):
    """doc_id, words, removed, digest and kept text per row, by a table of every window."""
    first = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for p in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[p : p + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone.update(range(p, p + length))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["é", "the", "a", "b", "c", "日本", *map(str, range(40))]
    fresh = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [fresh(rng.randint(8, 40)) for _ in range(6)] + [["hot"] * 30, ["x", "y"] * 12]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else fresh(rng.randint(0, 25)) for _ in range(rng.randint(0, 6))]
        rows.append([rng.randint(0, 10**6), rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p), "k", 1])
    for i in range(25):
        rows.append([rng.randint(0, 10**6), rng.choice(rows)[1], "k", 1])  # exact copies
        near = rng.choice(rows)[1].split()
        if near:
            near[rng.randrange(len(near))] = "edit"
        rows.append([rng.randint(0, 10**6), " ".join(near), "k", 1])
    rows += [[5, None, "k", 1], [6, "", "k", 1], [None, rows[0][1], "k", 1], rows[3], [rows[3][0], "other " * 60, "k", 1]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed,length,anchor,followers", [(1, 10, 3, 1000), (2, 7, 4, 2), (3, 20, 5, 1)])
def test_equal_to_brute_force(spark, seed, length, anchor, followers):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = repeat_report(docs, length, anchor, followers).collect()
    want = brute(rows, length)
    order = lambda r: tuple(map(str, r))
    assert sum(w[2] for w in want) > 500
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=order) == sorted(
        (w[:4] for w in want), key=order
    )
    kept = remove_repeats(docs, length, anchor, followers)
    assert kept.columns == docs.columns
    expected = [(w[0], w[4] if w[2] else r[1], "k", 1) for w, r in zip(want, rows)]
    assert sorted((tuple(r) for r in kept.collect()), key=order) == sorted(expected, key=order)


def test_production_length_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeat_report(docs).collect()}
    assert got == {w[0]: w[1:4] for w in brute(rows, 50)}
    assert any(v[1] for v in got.values())


def test_runs_cover_all_windows():
    rng = np.random.default_rng(1)
    for n in (3, 10, 11, 200):
        hashes = rng.integers(0, 5, n).astype(np.uint64)
        _, _, first, last = anchored_runs(hashes, 10, 4)
        assert [p for a, b in zip(first, last) for p in range(a, b + 1)] == list(range(max(0, n - 9)))


def test_automaton_follows_every_alignment():
    phrases = PhraseAutomaton(6)
    phrases.add(1, "a b c d e f g h i")
    phrases.add(9, "q q q q q q")
    assert phrases.covered(5, "z b c d e f g x a b c d e") == [(1, 7)]
    assert phrases.covered(5, "q q q q q q q q") == [] and phrases.covered(10, "q q q q q q q q") == [(0, 8)]


def test_empty(spark):
    assert repeat_report(spark.createDataFrame([], SCHEMA)).collect() == []
