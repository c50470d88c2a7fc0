import random

import pytest

from emberlog.llm import jaccard
from emberlog.llm.common import components, thinned
from emberlog.llm.jaccard import jaccard_components, keep_one_of_component
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, node long, n string"


def shingles(text, words_each):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words_each]) for i in range(len(w) - words_each + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, words_each=5, percent=80):
    sets = [shingles(t, words_each) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Ä", "the"]
    fresh = lambda k: [rng.choice(vocab) for _ in range(k)]
    base = fresh(60)
    texts = [fresh(rng.randint(0, 40)) for _ in range(60)]
    for _ in range(60):  # a large group of near copies
        near = list(base)
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(60)] = rng.choice(vocab)
        texts.append(near)
    chain = fresh(50)
    for _ in range(12):  # each like the last, the ends unlike
        chain = chain[2:] + fresh(2)
        texts.append(list(chain))
    passage = fresh(20)
    texts += [fresh(8) + passage + fresh(8) for _ in range(30)]
    texts += [rng.choice(texts) for _ in range(40)]
    rows = [(i * 7 % 1009, rng.choice([" ", "\n"]).join(t).replace("the", rng.choice(["the", "THE"])), 1, "n") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(5000, None, 1, "n"), (5001, "", 1, "n"), (5002, " \t", 1, "n"), (None, rows[0][1], 1, "n"), rows[1], rows[1]]


@pytest.mark.parametrize("seed,words_each,percent", [(1, 5, 80), (2, 2, 60), (3, 5, 90)])
def test_equal_to_brute_force(spark, seed, words_each, percent):
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), words_each, percent).collect()
    want = brute(rows, words_each, percent)
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(want, key=order)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == sorted(brute(rows)) and any(r[0] != r[2] for r in got)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(4)
    kept = keep_one_of_component(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "n"]
    want = {r for r in brute(rows) if r[0] == r[2] and r[0] is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(df).collect() == [] and keep_one_of_component(df).collect() == []


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 999: 999, 1000: 999}


def test_thinned_keeps_all_wanted(spark):
    df, wanted = spark.range(5000), spark.range(0, 5000, 100)
    left = {r.id for r in thinned(df, F.col("id"), wanted, F.col("id"), bits=16).collect()}
    assert set(range(0, 5000, 100)) <= left and len(left) < 200


def family(members, edits, seed=5):
    """Near copies of one text of 120 words, each with so many words of its own."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(members):
        near = list(base)
        for place in rng.sample(range(120), edits(i)):
            near[place] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), 1, "n"))
    return rows


@pytest.mark.parametrize(
    "edits,sizes,most",
    # linked to one pivot: no pairs; all below the threshold: those whose rarest differences meet, of members**2 / 2
    [(lambda i: i % 5, (200, 400), lambda m: m), (lambda i: 2, (300,), lambda m: m * m / 20)],
    ids=["mixed", "below"],
)
def test_few_pairs_of_a_family_are_compared(spark, monkeypatch, edits, sizes, most):
    compared = []

    def counting(made):
        def pairs(*args):
            found = made(*args)
            compared.append(found.count())
            return found

        return pairs

    for name in ("_pairs_of_families", "_open_pairs"):
        monkeypatch.setattr(jaccard, name, counting(getattr(jaccard, name)))
    for members in sizes:
        compared.clear()
        rows = family(members, edits)
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
        assert sum(compared) <= most(members), (members, compared)


@pytest.mark.parametrize("short_list", [2, 16])
def test_long_lists_lose_no_link(spark, monkeypatch, short_list):
    """Passages of many texts, large clusters of far and near copies, and copies that make all of it look common."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    rng = random.Random(11)
    fresh = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    passage, base, texts = fresh(53), fresh(60), []
    for _ in range(40):
        texts.append(fresh(rng.randint(5, 51)) + passage)
    for k in range(40):
        near = list(base)
        for _ in range(k % 8):
            near[rng.randrange(60)] = fresh(1)[0]
        texts.append(near)
    texts += [fresh(3) + rng.choice(texts) for _ in range(20)]
    texts += texts[::2] * 3
    rows = [(k, " ".join(t), 1, "n") for k, t in enumerate(texts)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_passage_of_many_texts_makes_no_pairs(spark, monkeypatch):
    """Texts alike in a common passage only are not counted pair by pair, though copies make all their shingles common."""
    rng = random.Random(5)
    fresh = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    passage, counted, verify = fresh(53), [], jaccard.verified
    texts = [" ".join(fresh(51) + passage) for _ in range(60)]
    rows = [(k, text, 1, "n") for k, text in enumerate(texts * 10)]

    def verified(pairs, *more):
        counted.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(jaccard, "verified", verified)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.component_id for r in got) == sorted([*range(60)] * 10)
    assert sum(counted) < 60
