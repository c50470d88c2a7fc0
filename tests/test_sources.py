"""Text files in, JSON lines out."""

import json

from pyspark.sql import functions as F

from emberlog.operators.retrieve import pins_status, recent, retain_newest
from emberlog.plans.lines_catalog import ENTRIES
from emberlog.sources.export import export_jsonl
from emberlog.sources.fixtures import log_events
from emberlog.sources.lines import read_lines
from tests.conftest import SF


def test_read_lines(spark, tmp_path):
    (tmp_path / "api.log").write_text("one\n\n  \ntwo\nthree\n")
    (tmp_path / "web.log").write_text("only\n")
    rows = read_lines(spark, f"{tmp_path}/*.log", "main").orderBy("source", "seq").collect()
    assert [(r["source"], r["branch"], r["line"]) for r in rows] == [
        ("api", "main", "one"), ("api", "main", "two"), ("api", "main", "three"), ("web", "main", "only")
    ]


def test_equal_file_names_are_different_sources(spark, tmp_path):
    for host in ("h1", "h2"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "app.log").write_text(f"{host} a\n  b\n")
    rows = read_lines(spark, f"{tmp_path}/*/*.log").collect()
    assert {(r.source, r.line) for r in rows} == {(f"{h}/app", x) for h in ("h1", "h2") for x in (f"{h} a", "  b")}
    rows = read_lines(spark, f"{tmp_path}/*/*.log", source_pattern=r"/(h\d)/").collect()
    assert {r.source for r in rows} == {"h1", "h2"}
    assert {r.source for r in read_lines(spark, f"{tmp_path}/h1").collect()} == {"app"}


def test_export_jsonl(spark, tmp_path):
    events = log_events(spark, SF)
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    export_jsonl(events, f"{tmp_path}/out", ids)
    rows = sorted((json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()), key=lambda e: e["id"])
    assert list(rows[0]) == ["id", "ts", "source", "branch", "level", "msg", "raw"]  # a plain event has no fields
    assert rows[1]["msg"].endswith(f"by user {rows[1]['fields']['user']['id']}")


def test_retention_and_paging(spark):
    events = log_events(spark, SF)
    kept = retain_newest(events, 10)
    assert kept.agg(F.min("id"), F.count("*")).first() == (991, 10)
    assert [r["id"] for r in recent(kept, 3).collect()] == [1000, 999, 998]
    assert retain_newest(events, 0).count() == 1


def test_read_lines_query_keeps_line_numbers(spark, tmp_path):
    rows = [(7, "a\n\n b\\\"c\n", "web"), (8, "one\rtwo", "x/y=z %"), (9, None, "web"), (10, "no source", None), (11, "\t", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.seq, r.line) for r in ENTRIES["read_lines"][0](spark, str(tmp_path)).collect()}
    assert got == {("web", 700000, "a"), ("web", 700002, ' b\\"c'), ("x/y=z %", 800000, "one\rtwo"), (None, 1000000, "no source")}


def test_pins_status_sends_no_log_to_the_driver(spark):
    """The size of a log's files says little of its rows, which must not be broadcast on its account."""
    pins = spark.createDataFrame([(2,), (2,), (-5,)], "id bigint")
    found = pins_status(pins, log_events(spark, SF))
    assert {(r.id, r.present) for r in found.collect()} == {(2, True), (-5, False)}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
