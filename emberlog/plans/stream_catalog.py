"""Registered streaming queries: each runs over what its source holds and returns the sink's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.plans import code_catalog as K
from emberlog.plans import events_catalog as E
from emberlog.plans import facets_catalog as A
from emberlog.plans import lines_catalog as N

from emberlog.sources.fixtures import as_log_events, line_shapes, log_events, with_event_columns
from emberlog.streaming import streams as S

ENTRIES: dict = {}


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return as_log_events(with_event_columns(S.stream_table(spark, sf, "events")))


def line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return line_shapes(S.stream_table(spark, sf, "events"))


def _add(name: str, run, sql: str | None) -> None:
    ENTRIES[name] = (run, sql)


def _stream_events(s: SparkSession, d: str) -> DataFrame:
    out = S.new_folder(s, "stream-events")
    S.run_available(S.stream_events(line_stream(s, d)), out)
    return s.read.parquet(f"{out}/rows").select("seq", "source", "level", "msg")


_add("stream_events", _stream_events,
     N.PARSED.rstrip() + ",\nseen AS (SELECT * FROM parsed WHERE regexp_matches(raw, '\\S')),\n" + N.rules_ctes("seen") + " SELECT seq, source, level, msg FROM ruled")
_add("stream_join_json", lambda s, d: S.stream_join_json(line_stream(s, d), S.new_folder(s, "stream-json")).select("source", "seq", "line"),
     N.ENTRIES["join_multiline_json"][1])
_add("stream_coalesce", lambda s, d: S.stream_coalesce(line_stream(s, d), S.new_folder(s, "stream-groups")).select(
         "source", "seq", "level", "msg", "raw", "lines"),
     N.ENTRIES["coalesce_events"][1])
_add("stream_search", lambda s, d: S.stream_search(event_stream(s, d), "level:error dur_ms:>=percentile(90)", S.new_folder(s, "stream-search")).select("id", "msg"),
     E.LOG + f"SELECT id, msg FROM log_events WHERE level = 'error' AND dur_number >= {E.threshold(90)}")
_add("stream_histogram", lambda s, d: S.stream_histogram(event_stream(s, d), 86_400_000, S.new_folder(s, "stream-histogram")),
     E.LOG + """SELECT ts // 86400000 * 86400000 AS ts, count(*) FILTER (WHERE level = 'error') AS err, count(*) FILTER (WHERE level = 'warn') AS warn,
     count(*) FILTER (WHERE level NOT IN ('error', 'warn')) AS rest, count(*) AS total FROM log_events GROUP BY 1""")
_add("stream_facets", lambda s, d: S.stream_facets(event_stream(s, d), S.new_folder(s, "stream-facets")).select("path", "value", "count"),
     A.FACETS + "SELECT path, value, count FROM counts")


def _stream_message_index(s: SparkSession, d: str) -> DataFrame:
    old = log_events(s, d).filter(F.col("ts") < 1_704_672_000_000)
    return S.stream_message_index(event_stream(s, d), S.new_folder(s, "stream-index"), old).read()


_add("stream_message_index", _stream_message_index,
     A.ENTRIES["trigram_index"][1].replace("FROM log_events GROUP BY msg", "FROM log_events WHERE ts >= 1704672000000 GROUP BY msg"))
_add("stream_alerts", lambda s, d: S.stream_alerts(event_stream(s, d), E.RULES, S.new_folder(s, "stream-alerts"), E.NOW_MS)[1],
     E.ENTRIES["alert_fires"][1])


def _stream_relevance(s: SparkSession, d: str) -> DataFrame:
    events = K.with_code_messages(event_stream(s, d), K.part_count(s, d))
    return S.stream_relevance(events, lambda: K.patterns(s, d), S.new_folder(s, "stream-relevance"))


_add("stream_relevance", _stream_relevance, K.ENTRIES["match_relevance"][1])
