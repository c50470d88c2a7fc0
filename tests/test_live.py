"""Standing streams: silence, changed keys, changed patterns; killed and started again."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from emberlog.operators import retrieve
from emberlog.operators.coalesce import coalesce_events
from emberlog.operators.facets import value_counts
from emberlog.operators.multiline import join_multiline_json
from emberlog.operators.normalise import parse_event
from emberlog.operators.predicates import number_of
from emberlog.operators.relevance import match_relevance
from emberlog.sources.fixtures import log_events
from emberlog.sources.lines import read_lines
from emberlog.streaming import streams as S
from emberlog.streaming.order_stats import JudgedStream, LivePercentiles
from emberlog.streaming.upsert import GONE, KeyedTable
from tests.conftest import SF
from tests.test_streaming import in_files, rows

SCHEMA = "source string, seq bigint, arrival_ms bigint, branch string, line string"


def wait_for(ready, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if ready():
            return True
        time.sleep(0.5)
    return False


def test_a_silent_source_gives_out_its_last_groups(spark, tmp_path):
    first = [("a", 0, 0, "", "ERROR one"), ("a", 1, 1, "", "    at f"), ("a", 2, 2, "", "{"), ("a", 3, 3, "", '"k": 1'), ("b", 0, 0, "", "INFO x")]
    second = [("a", 4, 9000, "", "}"), ("a", 5, 9001, "", "INFO y"), ("c", 0, 9000, "", "WARN z")]
    columns = ("source", "seq", "msg", "raw", "lines")
    frames = [spark.createDataFrame(part, SCHEMA) for part in (first, second)]
    done = []
    for part in frames:  # the query is killed between the two and started again
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        done.append(part)
        whole = done[0] if len(done) == 1 else done[0].unionByName(done[1])
        want = rows(coalesce_events(parse_event(join_multiline_json(whole, 150)), 150), *columns)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = S.start_coalesce(stream, f"{tmp_path}/out", quiet_ms=300)
        try:
            def found():
                try:
                    return rows(spark.read.parquet(f"{tmp_path}/out/rows"), *columns)
                except Exception:  # nothing written yet
                    return []

            assert wait_for(lambda: query.exception() is None and len(found()) >= len(want)), found()
            assert found() == want
        finally:
            query.stop()
    assert want[0][4] == 2 and sum(r[4] for r in want) >= 7


def test_keyed_table_writes_what_changes(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"])
    model, written = {}, []
    for version in range(12):
        rows_ = [(k, version, k % 7 == version) for k in (range(2000) if version == 0 else range(version * 10, version * 10 + 20))]
        for k, v, gone in rows_:
            model.pop(k, None) if gone else model.__setitem__(k, v)
        df = spark.createDataFrame(rows_, "k bigint, v bigint, _gone boolean")
        if version == 5:  # fails after writing, runs again
            table.upsert(df, version)
        written.append(table.upsert(df, version))
        assert {r.k: r.v for r in table.read(version).collect()} == model
    assert max(written[1:]) < 400  # rows; the table has two thousand
    before = {r.k: r.v for r in table.read(10).collect()}
    assert before != model and len(before) >= len(model) - 20
    assert GONE not in table.read().columns and KeyedTable(spark, f"{tmp_path}/none", ["k"]).read() is None


def test_facets_and_histogram_over_batches(spark, tmp_path):
    events = log_events(spark, SF).select("id", "ts", "source", "branch", "level", "msg", "raw", F.to_json("fields").alias("f"))
    stream = in_files(spark, events, "id", f"{tmp_path}/in", parts=4).withColumn("fields", F.try_parse_json("f")).drop("f")
    got = S.stream_facets(stream, f"{tmp_path}/facets")
    assert rows(got, "path", "value", "count") == rows(value_counts(log_events(spark, SF)), "path", "value", "count")
    day = 86_400_000
    want = sorted((r.ts // day * day,) for r in events.select("ts").collect())
    for watermark in (None, "0 seconds", "36500 days"):
        out = f"{tmp_path}/h{watermark}"
        found = S.stream_histogram(stream, day, out, watermark)
        if watermark != "0 seconds":
            assert sum(r.total for r in found.collect()) == len(want)
        assert S.last_batch(spark, out) >= 3
    again = S.stream_facets(stream, f"{tmp_path}/facets")  # started again, nothing is new
    assert rows(again, "path", "value", "count") == rows(value_counts(log_events(spark, SF)), "path", "value", "count")


def test_changed_patterns_reach_earlier_events(spark, tmp_path):
    kind = "source string, rel_path string, line int, raw_call string, pieces array<string>, regex string, kind string"
    table = {
        "old": ("s", "a.ts", 1, "log(old)", ["stored old"], "stored old", "direct"),
        "both": ("s", "b.ts", 2, "log(b)", ["stored"], "stored", "indirect"),
        "new": ("s", "c.ts", 3, "log(new)", ["fresh"], "fresh", "direct"),
    }
    now = {"names": ["old", "both"]}
    patterns = lambda: spark.createDataFrame([table[n] for n in now["names"]], kind)
    events = spark.createDataFrame(
        [(i, "s", f"{('stored old', 'stored it', 'fresh item', 'nothing')[i % 4]} {i}", "raw") for i in range(40)],
        "id bigint, source string, msg string, raw string",
    )
    stream = in_files(spark, events, "id", f"{tmp_path}/in", parts=2)
    columns = ("id", "source", "rel_path", "line", "raw_call", "kind")
    for names in (["old", "both"], ["old", "both", "new"], ["new", "both"], ["new"], []):
        now["names"] = names
        if len(names) == 1:  # and new events come with the change
            more = spark.createDataFrame([(i, "s", f"fresh {i}", "stored old") for i in range(40, 50)], events.schema)
            more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events = events.unionByName(more)
        got = S.stream_relevance(stream, patterns, f"{tmp_path}/out")
        assert rows(got, *columns) == rows(match_relevance(events, patterns()), *columns), names


def test_percentiles_keep_up(spark, tmp_path):
    rng = random.Random(2)
    draws = {"skew": lambda: rng.lognormvariate(0, 4), "flat": lambda: float(rng.randint(-5, 5)), "late": lambda: 7.0}
    wanted = [("skew", 50.0), ("skew", 95.0), ("flat", 0.0), ("flat", 80.0), ("late", 50.0), ("none", 50.0)]
    live = LivePercentiles(spark, f"{tmp_path}/p", wanted)
    seen = {k: [] for k in ("skew", "flat", "late", "none")}
    for number in range(5):
        rows_ = []
        for i in range(60):
            fields = {k: draw() * (1 + number) for k, draw in draws.items() if rng.random() < 0.8 and (k != "late" or number > 2)}
            for k, v in fields.items():
                seen[k].append(v)
            rows_.append((i, json.dumps(fields)))
        batch = spark.createDataFrame(rows_, "id bigint, f string").withColumn("fields", F.try_parse_json("f")).drop("f")
        if number == 3:  # runs twice, as after a failure
            live.add(batch, number)
        got = live.add(batch, number)
        for k, p in wanted:
            s = sorted(seen[k])
            assert got[k, p] == (s[min(len(s) - 1, int(p / 100 * len(s)))] if s else 0.0), (number, k, p)


def test_unmoved_thresholds_leave_earlier_events_alone(spark, tmp_path):
    """Batches of the same values: every threshold stays, so nothing is judged twice."""
    judged = []

    def judge(df, limits):
        judged.append(df.count())
        return df.withColumn(GONE, number_of("x") < limits["x", 50.0]).select("id", GONE)

    live = JudgedStream(spark, f"{tmp_path}/j", [("x", 50.0)], judge)
    for number in range(3):
        batch = spark.createDataFrame([(number * 10 + i, json.dumps({"x": i % 5})) for i in range(10)], "id bigint, f string")
        live.add(batch.withColumn("fields", F.try_parse_json("f")).drop("f"), number)
    assert judged == [10, 10, 10] and live.table.read().count() == 18
    shifted = spark.createDataFrame([(100 + i, json.dumps({"x": 3})) for i in range(60)], "id bigint, f string")
    live.add(shifted.withColumn("fields", F.try_parse_json("f")).drop("f"), 3)
    assert judged[3:] == [60, 12]  # the earlier ones between the median of before, 2, and of now, 3
    assert live.table.read().count() == 60 + 12


def test_text_files_arrive_in_order(spark, tmp_path):
    """A log continued in a second file, through the live reader and the grouping of lines."""
    parts = [["INFO a 1", "ERROR a 2", "    at f"], ["    at g", "", "{", '"k": 1', "}", "WARN a 3"]]
    sources = {}
    for number, lines in enumerate(parts):
        for name in ("app", "web"):
            (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name / f"{number}.log").write_text("\n".join(lines) + "\n")
            sources.setdefault(name, []).extend(lines)
        stream = read_lines(spark, f"{tmp_path}/in/*/*.log", stream=True, source_pattern=r"/([^/]+)/\d+\.log")
        got = S.stream_coalesce(stream, f"{tmp_path}/out", None)
    columns = ("source", "msg", "raw", "lines")
    flat = [(s, i, "", line) for s, lines in sources.items() for i, line in enumerate(lines) if line]
    whole = spark.createDataFrame(flat, "source string, seq bigint, branch string, line string")
    assert rows(got, *columns) == rows(coalesce_events(parse_event(join_multiline_json(whole, None)), None), *columns)
    order = [r.msg for r in got.filter("source = 'app'").orderBy("seq").collect()]
    assert order[0] == "INFO a 1" and order[-1] == "WARN a 3" and got.filter("lines = 3").count() == 2


@pytest.mark.parametrize("keep", [1, 2, 7, 50, 99, 100, 500])
def test_newest_events_by_counting(spark, monkeypatch, keep):
    monkeypatch.setattr(retrieve, "ID_RANGES", 4)
    ids = [3, 3, 10**12, -5] + [i * i for i in range(96)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = sorted(r.id for r in retrieve.retain_newest(df, keep).collect())
    low = sorted(ids, reverse=True)[min(keep, len(ids)) - 1]
    assert got == sorted(i for i in ids if i >= low)
    assert retrieve.retain_newest(df.limit(0), keep).count() == 0
