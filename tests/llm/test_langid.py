import random
import zlib

from pyspark.sql import functions as F

from emberlog.llm.langid import fit, identify_language, keep_identified, letter_table, spectrum

SF = "/root/testdata/sf0.001"


def test_spectrum_is_the_set_of_grams():
    table = letter_table()
    for text in ["", "a", "Ab", "aé b!!  1c", "日本語 x", "𝒳y😀"]:
        plain = "".join(c if c.isalpha() or ord(c) > 0xFFFF else " " for c in text.lower())
        while "  " in plain:
            plain = plain.replace("  ", " ")
        want = {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}
        assert len(spectrum(text, table)) == len(want)


def test_kernel_by_brute_force():
    texts = ["the cat and the dog", "der hund und die katze", "the bird", "die maus"]
    model = fit(texts, ["en", "de", "en", "de"], landmarks_per_language=2)
    table = letter_table()
    sets = [set(spectrum(t, table).tolist()) for t in texts]
    got = model.kernel([spectrum(t, table) for t in texts])
    order = [1, 3, 0, 2]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[k] for k in order):
            assert abs(got[i, j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[1] > 30 and right[0] > 0.93


def test_edges_and_columns(spark):
    rng = random.Random(2)
    english, german = "the and of to in is that".split(), "der die und das nicht ist ein".split()
    rows = [(i, " ".join(rng.choice((english, german)[i % 2]) for _ in range(30)), ("en", "de")[i % 2], 1) for i in range(80)]
    rows += [(90, None, "en", 1), (91, "", "de", 1), (92, "12 !?", "en", 1), (None, "the of and", None, 1), (0, rows[0][1], "en", 1)]
    rows.append((93, "der und das " * 20_000, None, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = identify_language(docs).collect()
    assert [set(r.asDict()) for r in got][0] == {"doc_id", "held_out", "lang_pred", "score"} and len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    answer = {r.doc_id: r.lang_pred for r in got}
    assert [answer[k] for k in (90, 91, 92, None, 93)] == ["und", "und", "und", "en", "de"]
    assert sum(answer[i] == ("en", "de")[i % 2] for i in range(80)) >= 78
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert identify_language(docs.limit(0)).collect() == []
    nothing = identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_training_texts_are_read_whole(spark):
    blank = "1 " * 15_000  # the words begin after the first 20,000 characters
    texts = {"en": "the and of to in is that ", "de": "der die und das nicht ist ein "}
    docs = spark.createDataFrame([(i, blank + texts[k], k) for i, k in enumerate(["en", "de"] * 20)] + [(99, "die und das", None)],
                                 "doc_id long, text string, lang string")
    answer = {r.doc_id: r.lang_pred for r in identify_language(docs, texts_per_language=10).collect()}
    assert answer[99] == "de" and all(answer[i] == ("en", "de")[i % 2] for i in range(40))


def test_nothing_learned_keeps_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !?", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in keep_identified(docs).collect()] == [1]


def test_the_answer_decides_what_is_kept(spark):
    """Rows go by what the model answers, not by their label or by having letters."""
    rng = random.Random(4)
    words = {"en": "the and of to in is that".split(), "de": "der die und das nicht ist ein".split()}
    rows = [(i, " ".join(rng.choice(words[("en", "de")[i % 2]]) for _ in range(30)), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, "der und das ist nicht ein", "en"), (101, "the and of that is", None), (102, "12 !?", "en"), (103, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    answer = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs).collect()}
    assert answer[100][0] == "de" and answer[101][0] == "en"

    def kept(**how):
        return {r.doc_id for r in keep_identified(docs, **how).collect()}

    assert kept() == {i for i, (x, s) in answer.items() if x != "und" and s >= 0.4} == set(answer) - {102, 103}
    assert kept(wanted=["de"]) == {i for i, (x, s) in answer.items() if x == "de" and s >= 0.4} and 100 in kept(wanted=["de"])
    assert kept(wanted=[]) == set()
    middle = sorted(s for x, s in answer.values() if x != "und")[30]
    some = kept(least_score=middle)
    assert some == {i for i, (x, s) in answer.items() if x != "und" and s >= middle} and 0 < len(some) < len(answer) - 2
