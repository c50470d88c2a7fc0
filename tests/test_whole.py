"""Registered queries that take part whole, without the key filters of the smaller ones, against their twins."""

import duckdb
import pytest

from pyspark import TaskContext
from pyspark.sql import functions as F

import __spark_entry__ as registered
from emberlog.operators.alerts import alert_fires, match_alerts
from emberlog.operators.chain import run_chain
from emberlog.plans.events_catalog import NOW_MS, RULES
from emberlog.sources.fixtures import log_events
from emberlog.sources.lines import http_exchange_events
from emberlog.streaming import streams as S
from tests.conftest import SF
from tests.test_oracle import TABLES, plain
from tests.test_streaming import in_files, rows

WHOLE_DIFF = "touched_files diff_added_lines relevance_patterns match_relevance relevance_ids relevance_sites stream_relevance".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(spark, duck, name):
    """Rows of the query, columns by name, after comparing them with the twin's."""
    df = registered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()) and got
    return got


@pytest.mark.parametrize("name", WHOLE_DIFF)
def test_every_part_takes_part(spark, duck, name):
    got = rows_of(spark, duck, name)
    if name == "touched_files":  # all but the deleted file
        assert len(got) == duck.execute("SELECT count(*) FROM part WHERE p_partkey % 200 <> 51").fetchone()[0]


def test_barrels_of_barrels(spark, duck):
    got = rows_of(spark, duck, "expand_barrels")
    assert {o for _, o in got} > {repr(p) for (p,) in duck.execute(
        "SELECT 'src/p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.java' ELSE '.ts' END FROM part").fetchall()}
    last = [o for m, o in got if m == "'hub0'"]  # ten hubs in a row: each hands on two modules and itself
    assert len(last) == 30 and "'src/p92.ts'" in last and "'src/hub9/index.ts'" in last


def test_alerts_on_percentiles(spark, duck, tmp_path):
    events = log_events(spark, SF)
    stream = in_files(spark, events.withColumn("f", F.to_json("fields")).drop("fields"), "id", f"{tmp_path}/in")
    stream = stream.withColumn("fields", F.try_parse_json("f")).drop("f")
    want = match_alerts(events, RULES, NOW_MS)
    assert want.filter(F.array_contains("alert_ids", "d-slow")).count() > 5
    for _ in range(2):  # started again, nothing is new
        matches, fires = S.stream_alerts(stream, RULES, f"{tmp_path}/alerts", NOW_MS)
        assert rows(matches, "id", "alert_ids") == rows(want, "id", "alert_ids")
        assert rows(fires, "id", "alert_id", "suppressed") == rows(alert_fires(want, RULES), "id", "alert_id", "suppressed")
    for name in ("stream_alerts", "match_alerts_delta"):
        rows_of(spark, duck, name)


def test_http_columns_keep_the_whole_url(spark, duck):
    url = "https://shop.test/" + "ab" * 300 + "?tail=1"
    exchange = spark.createDataFrame([("web", 1, "get", url, 404, "Not Found", None)],
                                     "source string, ts long, method string, url string, status int, status_text string, error string")
    got = http_exchange_events(exchange).filter(F.col("url").endswith("?tail=1")).orderBy("part").collect()
    assert [(r.part, r.method, r.url, r.status) for r in got] == [(0, "get", url, 404), (1, "get", url, 404)]
    assert all(r.msg.endswith("…") for r in got)
    rows_of(spark, duck, "http_exchange_events")


def test_chunks_of_a_hot_source_are_dealt_out(spark, tmp_path):
    def step(rows):
        task = TaskContext.get()
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(f"{task.stageId()} {task.partitionId()}\n")
        return rows.index.to_numpy() + 1

    lines = spark.range(2000).select(F.lit("hot").alias("source"), F.col("id").alias("seq"))
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # as with a large table
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = run_chain(lines, ["source"], ["seq"], step, 5, 10)
        assert got.filter("start = pos").count() == 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    calls = [line.split() for line in open(f"{tmp_path}/calls")]
    for stage in {s for s, _ in calls}:
        assert len({p for s, p in calls if s == stage}) > 1
