"""Streams over several micro-batches give what one batch run gives."""

from pyspark.sql import functions as F

from emberlog.operators.alerts import alert_fires, match_alerts
from emberlog.operators.coalesce import coalesce_events
from emberlog.operators.facets import value_counts
from emberlog.operators.multiline import join_multiline_json
from emberlog.operators.normalise import parse_event
from emberlog.operators.search import search
from emberlog.plans.events_catalog import NOW_MS, PLAIN_RULES
from emberlog.sources.fixtures import log_events, raw_lines
from emberlog.streaming import streams as S
from tests.conftest import SF


def in_files(spark, df, order, folder, parts=3):
    """Write ``df`` as a few files in order and read them as a stream, one file per micro-batch."""
    top = df.agg(F.max(order)).first()[0] + 1
    for i in range(parts):
        cut = df.filter((F.col(order) >= top * i // parts) & (F.col(order) < top * (i + 1) // parts))
        cut.coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_groups(spark, tmp_path):
    lines = raw_lines(spark, SF).filter("seq < 4000").withColumn("arrival_ms", F.floor(F.col("seq") / 30) * 1000)
    stream = in_files(spark, lines, "seq", f"{tmp_path}/in")
    got = S.stream_coalesce(stream, f"{tmp_path}/out")
    want = coalesce_events(parse_event(join_multiline_json(lines, 150)))
    columns = ("source", "seq", "level", "msg", "raw", "lines")
    assert rows(got, *columns) == rows(want, *columns)
    assert want.filter("lines > 1").count() > 10
    # started again with nothing new to read, the carried lines are still there
    assert rows(S.stream_coalesce(stream, f"{tmp_path}/out"), *columns) == rows(want, *columns)


def test_percentile_filter_is_taken_over_everything(spark, tmp_path):
    events = log_events(spark, SF).select("id", "ts", "source", "branch", "level", "msg", "raw", F.to_json("fields").alias("f"))
    stream = in_files(spark, events, "id", f"{tmp_path}/in").withColumn("fields", F.try_parse_json("f")).drop("f")
    got = S.stream_search(stream, "dur_ms:>=percentile(80)", f"{tmp_path}/out", NOW_MS)
    want = search(log_events(spark, SF), "dur_ms:>=percentile(80)")
    assert rows(got, "id") == rows(want, "id")
    again = S.stream_search(stream, "dur_ms:>=percentile(80)", f"{tmp_path}/out", NOW_MS)
    assert rows(again, "id") == rows(want, "id")


def test_a_standing_stream_hands_out_its_query(spark, tmp_path):
    lines = raw_lines(spark, SF).filter("seq < 300")
    stream = in_files(spark, lines, "seq", f"{tmp_path}/in", parts=2)
    query = S.start_stream(stream, f"{tmp_path}/out", trigger={"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(f"{tmp_path}/out/rows").count() == lines.count()
    finally:
        query.stop()
    assert S.last_batch(spark, f"{tmp_path}/out") == 1 and S.last_batch(spark, f"{tmp_path}/none") == -1


def test_alerts_and_facets(spark, tmp_path):
    events = log_events(spark, SF).select("id", "ts", "source", "branch", "level", "msg", "raw", F.to_json("fields").alias("f"))
    stream = in_files(spark, events, "id", f"{tmp_path}/in").withColumn("fields", F.try_parse_json("f")).drop("f")
    _, fires = S.stream_alerts(stream, PLAIN_RULES, f"{tmp_path}/alerts", NOW_MS)
    want = alert_fires(match_alerts(log_events(spark, SF), PLAIN_RULES, NOW_MS), PLAIN_RULES)
    columns = ("id", "alert_id", "ts", "suppressed", "body")
    assert rows(fires, *columns) == rows(want, *columns)
    facets = S.stream_facets(stream, f"{tmp_path}/facets")
    counts = rows(value_counts(log_events(spark, SF)), "path", "value", "count")
    assert rows(facets, "path", "value", "count") == counts
    assert rows(S.stream_facets(stream, f"{tmp_path}/facets"), "path", "value", "count") == counts
