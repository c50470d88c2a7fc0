import random
from zlib import crc32

import numpy as np
import pytest

from emberlog.llm.catalog import op12_factorisation_machine
from emberlog.llm.quality import RANK, WIDTH, Machine, _raw, fit, quality_scores
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(doc_id):
    return crc32(str(doc_id).encode()) % 4 == 2


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    linear, factors = rng.normal(size=WIDTH), rng.normal(size=(WIDTH, RANK))
    texts = [rng.choice(WIDTH, n, replace=False) for n in (1, 5, 30)]
    values = [rng.normal(size=len(t)) for t in texts]
    starts = np.cumsum([0, 1, 5])
    got = _raw(0.25, linear, factors, np.concatenate(texts), np.concatenate(values), starts)[0]
    for text, value, total in zip(texts, values, got):
        pairs = sum(
            factors[text[a]] @ factors[text[b]] * value[a] * value[b] for a in range(len(text)) for b in range(a + 1, len(text))
        )
        assert total == pytest.approx(0.25 + linear[text] @ value + pairs)


def test_pairs_are_learned():
    """Neither word tells anything alone: only the product of the two does."""
    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.randint(0, 1), rng.randint(0, 1)
        rows.append((np.array([10 + a, 20 + b], np.int32), np.array([0.7, 0.7], np.float32), [0.0] * 15))
        labels.append(float(a == b))
    machine = fit(rows, np.array(labels))
    scores = machine.scores([machine.columns(*r) for r in rows])
    assert ((scores > 0.5) == np.array(labels, bool)).mean() > 0.95
    again = Machine.load(machine.dump())
    assert np.array_equal(again.scores([again.columns(*r) for r in rows]), scores)


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01"), SF.replace("0.001", "0.1")])
def test_held_out_accuracy(spark, folder):
    got = {r.doc_id: r for r in op12_factorisation_machine(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    marked = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    marked = [(q, r) for q, r in marked if r.held_out]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(r.predicted == q for q, r in marked) >= 0.95 * len(marked)


def test_neither_labels_nor_other_columns_of_held_out_rows_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda d, m: {r.doc_id: r.score for r in quality_scores(d, m).collect()}
    before = scores(docs, labels)
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2, 1 - quality, quality) AS quality")
    other = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "n_chars", "1 AS score", "2 AS label", "3 AS held_out")
    assert scores(other, turned) == before


def test_nulls_empty_long_repeated_and_nothing_learned(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    texts = [(i, ("good words here and there. " if i % 2 else "## %% ## @@ ") * (i + 1), None, None, i) for i in range(40)]
    odd = [(None, "no id", None, None, 1), (100, None, None, None, None), (101, "", None, None, 0), (7, "twice", None, None, 5), (102, "wort " * 600_000, None, None, -3)]
    docs = spark.createDataFrame(texts + odd, DOCS)
    got = quality_scores(docs, labels).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    for marks, rows in ((labels.limit(0), docs), (labels, docs.limit(0)), (labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality"), docs)):
        plain = quality_scores(rows, marks).collect()
        assert all(r.score == 0.5 and r.predicted == 0 for r in plain) and len(plain) == rows.count()


def test_the_sample_is_bounded_by_its_argument(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    few = {r.doc_id: r.score for r in quality_scores(docs, labels, sample_rows=20).collect()}
    assert len(few) == docs.count() and few != {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
