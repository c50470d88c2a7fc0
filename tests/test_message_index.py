"""The maintained trigram index against one built anew."""

import random

import duckdb

from emberlog.operators.suggest import search_messages, trigram_index
from emberlog.plans.stream_catalog import ENTRIES
from emberlog.streaming.message_index import MessageIndex
from tests.conftest import SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    words = ["Up", "by", "User", "ok", "\u00dcber", "a", "", "GET /x", "aaaa"]
    held, index = [], MessageIndex(spark, f"{tmp_path}/index", buckets=8)
    assert rows(index.read()) == rows(index.search("abc")) == rows(index.search("a")) == []
    written = []
    for version in range(6):
        new = [" ".join(rng.choices(words, k=rng.randint(1, 4))).strip() for _ in range(40 if version == 0 else 8)]
        old = [held.pop(rng.randrange(len(held))) for _ in range(min(len(held), 9))] + new[:2]
        held += new[2:]
        frames = [spark.createDataFrame([(m,) for m in part], "msg string") for part in (new, old)]
        written.append(index.change(version, *frames))
        if version == 3:  # the same version once more, as after a failure
            index.change(version, *frames)
        now = spark.createDataFrame([(m,) for m in held], "msg string")
        assert rows(index.read().select("gram", "msg", "refs")) == rows(trigram_index(now))
        if version in (0, 5):
            for text in ("up b", "USER", "k ", "\u00fcBER", "aaaaa", "a", ""):
                assert rows(index.search(text)) == rows(search_messages(trigram_index(now), text))
    everything = spark.createDataFrame([(m,) for m in held], "msg string")
    index.change(6, evicted=everything)
    assert rows(index.read()) == rows(index.search("user")) == []
    plan = index.search("user", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_registered_stream(spark):
    run, sql = ENTRIES["stream_message_index"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = rows(run(spark, SF).select("gram", "msg", "refs"))
    assert got == sorted(con.execute(f"SELECT gram, msg, refs FROM ({sql})").fetchall()) and got
