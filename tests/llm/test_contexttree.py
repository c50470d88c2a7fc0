import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm.contexttree import _lgamma, score_documents

SCHEMA = "doc_id long, text string, score string, n long"


def text_bytes(text):
    return b" ".join((text or "").encode().lower().split())


class Tree:
    """A context tree of one binary decision, weighted recursively from its counts."""

    def __init__(self):
        self.counts, self.children = [0, 0], {}

    def add(self, context, bit):
        self.counts[bit] += 1
        if context:
            self.children.setdefault(context[0], Tree()).add(context[1:], bit)

    def own(self):
        a, b = self.counts
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, left):
        if not left:
            return self.own()
        below = sum(child.weighted(left - 1) for child in self.children.values())
        return float(np.logaddexp(self.own(), below) - math.log(2))

    def chance(self, context, bit):
        own = (self.counts[bit] + 0.5) / (sum(self.counts) + 1)
        if not context:
            return own
        below = sum(child.weighted(len(context) - 1) for child in self.children.values())
        share = 1 / (1 + math.exp(min(700, below - self.own())))
        child = self.children.get(context[0], Tree())
        return share * own + (1 - share) * child.chance(context[1:], bit)


def decisions(data, depth):
    padded = bytes([255]) * depth + data + b"\xff"
    for i in range(depth, len(padded)):
        context = tuple(padded[i - 1 - k] for k in range(depth))
        for shift in range(7, -1, -1):
            yield (256 | padded[i]) >> (shift + 1), context, padded[i] >> shift & 1


def brute(rows, depth):
    training = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    trees, words = {}, Counter()
    for i, text, *_ in rows:
        if training(i):
            for prefix, context, bit in decisions(text_bytes(text), depth):
                trees.setdefault(prefix, Tree()).add(context, bit)
            words.update([*text_bytes(text).split(), b" "])
    total = sum(words.values())
    out = []
    for i, text, *_ in rows:
        tokens = [*text_bytes(text).split(), b" "]
        score = sum(math.log10(trees.get(p, Tree()).chance(c, b)) for p, c, b in decisions(text_bytes(text), depth))
        base = sum(math.log10((words[t] + 1) / (total + len(words) + 1)) for t in tokens)
        held = i is not None and not training(i)
        out.append((i, held, len(tokens), sum(words[t] > 0 for t in tokens), total, base, score))
    return out


def corpus():
    rng = random.Random(1)
    vocab = ["the", "The", "cat", "é", "x", "日"]
    rows = [(i, rng.choice([" ", "\n\t"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 6))), "s", 1) for i in range(24)]
    return rows + [(30, None, "s", 1), (31, "", "s", 1), (None, "the cat", "s", 1), rows[1], rows[1], (37, "zz zz q", "s", 1)]


@pytest.mark.parametrize("depth,grams,words", [(2, 10**6, 10**6), (3, 10**6, 3), (5, 0, 0)])
def test_equal_to_recursive_trees(spark, depth, grams, words):
    rows = corpus()
    got = score_documents(spark.createDataFrame(rows, SCHEMA), depth, table_grams=grams, table_words=words).collect()
    assert set(got[0].asDict()) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    order = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(brute(rows, depth), key=order), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)


def test_model_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = score_documents(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert row[2] > 1000 and row[0] > row[1]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 9.5, 10, 77.5, 1e6])
    assert np.allclose(_lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_empty_and_untrained(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    one = score_documents(spark.createDataFrame([(None, "ab", "s", 1)], SCHEMA)).first()
    assert one.train_tokens == 0 and abs(one.score + 24 * math.log10(2)) < 1e-9 and one.base_score == 0
