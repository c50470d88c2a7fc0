import corpus_pipeline
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_substring import brute as repeats

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    results = []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs)
    language, near, cut, packed = results
    assert language.columns == near.columns == cut.columns == columns
    kept = {r.doc_id: r.text for r in language.collect()}
    assert kept == {i: r.text for i, r in given.items() if r.text and any(map(str.isalpha, r.text))}
    unique = {r.doc_id: r.text for r in near.collect()}
    assert unique == {i: kept[i] for i, _, c in groups(list(kept.items())) if i == c} and len(unique) < len(kept)
    rows = list(unique.items())
    want = {w[0]: (w[4] if w[2] else text) for w, (_, text) in zip(repeats(rows, 50), rows)}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert {r.doc_id for r in packed.collect()} == set(unique)


def test_registered():
    names = registered.queries()
    assert "pipeline" in names and sum(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) >= 8
    assert set(registered.oracle_sql()) <= set(names)
