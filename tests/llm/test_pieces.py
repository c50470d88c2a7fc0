import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from emberlog.llm import pieces
from emberlog.llm.pieces import MARK, Searches, Vocabulary, decode_segmentations, sample_segmentations, units_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, rank int, ids string"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


def all_segmentations(text, vocabulary):
    """Every segmentation and its weight, by recursion over the surface forms."""
    weight = dict(zip(vocabulary.ids.tolist(), vocabulary.weights.tolist()))
    pieces = {vocabulary.surface[i].decode(): i for i in weight}
    text = " " + text

    def spell(at):
        if at == len(text):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(text), at + 16) + 1):
            part = text[at:end]
            if part in pieces:
                ids, w = (pieces[part],), weight[pieces[part]]
            elif end == at + 1:
                raw = part.encode()
                ids, w = tuple(vocabulary.byte_ids[list(raw)].tolist()), float(vocabulary.byte_weights[list(raw)].sum())
            else:
                continue
            for rest, v in spell(end):
                yield ids + rest, w + v

    found = dict(spell(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["ab", "a,b.", "the cat", "a  b ", "x\ny", "é日𝒳", " lead"])
def test_all_segmentations_are_emitted_with_their_probability(spark, vocabulary, text):
    want = all_segmentations(text, vocabulary)
    got = sample_segmentations(spark.createDataFrame([(1, text, 0, "")], SCHEMA), PATH, k=len(want) + 5).collect()
    assert {tuple(r.ids): round(r.log_prob, 9) for r in got} == {ids: round(p, 9) for ids, p in want.items()}
    assert [r.log_inclusion for r in got] == [0.0] * len(want) and len(got) == len(want)
    values = [r.perturbed for r in sorted(got, key=lambda r: r["rank"])]
    assert values == sorted(values, reverse=True) and {r.decoded_crc32 for r in got} == {zlib.crc32(text.encode())}


@pytest.mark.parametrize("run", [1, 2, 8])
def test_draws_follow_the_law_of_sampling_without_replacement(vocabulary, monkeypatch, run):
    monkeypatch.setattr(pieces, "RUN", run)
    text, n = "thin", 20_000
    law = {ids: math.exp(p) for ids, p in all_segmentations(text, vocabulary).items()}
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    searches = Searches([units_of(text, re.compile(vocabulary.pattern))] * n, keys, vocabulary)
    searches.run(2)
    drawn = Counter(tuple(tuple(s[0].tolist()) for s in searches.samples(t, 2)) for t in range(n))
    chance = {(a, b): law[a] * law[b] / (1 - law[a]) for a, b in permutations(law, 2)}
    for pair in sorted(chance, key=chance.get, reverse=True)[:12]:
        assert abs(drawn[pair] / n - chance[pair]) < 5 * math.sqrt(chance[pair] / n) + 1e-3
    # weighting by inclusion makes the estimate of any mean unbiased
    share = np.mean([sum(math.exp(p - i) for _, p, _, i in searches.samples(t, 2)) for t in range(n)])
    assert abs(share - 1) < 0.02


def test_whole_texts_round_trip_and_samples_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = decode_segmentations(sample_segmentations(docs, PATH, k=3), PATH).collect()
    assert len(got) == 3 * len(texts)
    for r in got:
        assert r.decoded == texts[r.doc_id] and r.decoded_crc32 == zlib.crc32(r.decoded.encode()) and r.n_pieces == len(r.ids)
        assert r.log_inclusion <= 0 and r.log_prob < 0
    assert len({(r.doc_id, tuple(r.ids)) for r in got}) == len(got)
    again = sample_segmentations(docs.repartition(7), PATH, k=3).collect()
    assert {(r.doc_id, r["rank"], tuple(r.ids)) for r in again} == {(r.doc_id, r["rank"], tuple(r.ids)) for r in got}


def test_edges(spark, vocabulary):
    rows = [(1, None, 0, ""), (2, "", 0, ""), (None, "ab", 0, ""), (3, "ab", 0, ""), (3, "ab", 0, ""), (4, "x" * 60_000, 0, "")]
    rows += [(5, f"{MARK}", 0, ""), (-7, "\n\n", 0, "")]
    got = sample_segmentations(spark.createDataFrame(rows, SCHEMA), PATH, k=2).collect()
    count = Counter(r.doc_id for r in got)
    assert count == {2: 1, None: 2, 3: 4, 4: 2, 5: 2, -7: 1}
    long = [r for r in got if r.doc_id == 4]
    assert all(r.decoded_crc32 == zlib.crc32(b"x" * 60_000) for r in long)
    assert sample_segmentations(spark.createDataFrame([], SCHEMA), PATH).collect() == []
