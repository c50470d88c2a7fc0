"""Registered queries over dynamic fields: facets, percentiles, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import facets as A
from emberlog.operators import suggest as S
from emberlog.plans.fixture_sql import LOG_EVENTS, with_ctes
from emberlog.session import stage_table
from emberlog.sources.fixtures import log_events

ENTRIES: dict = {}


def wide_events(spark: SparkSession, sf: str) -> DataFrame:
    return log_events(spark, sf)


# leaves of the payload; arrays are leaves, their elements are not
LEAVES = r"""
leaves AS (
  SELECT e.id, e.ts, substr(t.fullkey, 3) AS path, t.type, e.event_id,
    CASE WHEN t.type = 'ARRAY' THEN array_to_string(CAST(from_json(t.value, '["VARCHAR"]') AS VARCHAR[]), ',')
         WHEN t.type = 'NULL' THEN 'null' ELSE regexp_replace(CAST(t.value ->> '$' AS VARCHAR), '^(\d+)\.0$', '\1') END AS text
  FROM log_events e, json_tree(e.fields) t
  WHERE e.fields IS NOT NULL AND t.type <> 'OBJECT' AND NOT contains(t.fullkey, '[')
)
"""
COUNTS = r"""
kept AS (SELECT id, ts, path, CASE WHEN type = 'NULL' THEN '' ELSE text END AS value, type = 'NULL' AS is_null FROM leaves
  WHERE path NOT IN ('level', 'source', 'branch', 'msg', 'raw', 'ts', 'id', 'timestamp') AND path <> 'created_at'),
counts AS (SELECT path, value, count(*) AS count, count(*) FILTER (WHERE is_null) AS nulls, min(id) AS first_id FROM kept GROUP BY 1, 2),
paths AS (SELECT path, count(*) AS distinct_values, min(first_id) AS first_id FROM counts GROUP BY 1 HAVING count(*) > 1)
"""
RANKED = r"""
prio AS (SELECT *, coalesce(list_position(['method', 'status_code', 'status', 'code', 'path', 'endpoint', 'url', 'request_id', 'trace_id', 'user.id', 'user_id'], path), 99) AS p FROM paths),
ranked_paths AS (SELECT path, row_number() OVER (ORDER BY p, distinct_values DESC, first_id, path) AS group_rank FROM prio),
ranked AS (
  SELECT c.path AS key, CASE c.path WHEN 'user.id' THEN 'User · Id' ELSE upper(left(c.path, 1)) || substr(c.path, 2) END AS label, group_rank, value, count, first_id,
    row_number() OVER (PARTITION BY c.path ORDER BY count DESC, c.first_id, value) AS value_rank
  FROM counts c JOIN ranked_paths r ON c.path = r.path WHERE group_rank <= 50),
level_group AS (SELECT 'level' AS key, 'Level' AS label, -2 AS group_rank, level AS value, count(*) AS count FROM scope GROUP BY level),
source_group AS (SELECT 'source' AS key, 'Source' AS label, -1 AS group_rank, source AS value, count(*) AS count FROM scope GROUP BY source),
branch_group AS (SELECT 'branch' AS key, 'Branch' AS label, 0 AS group_rank, branch AS value, count(*) AS count FROM scope WHERE branch <> '' GROUP BY branch),
fixed_groups AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY count DESC, value) AS value_rank FROM (
  SELECT * FROM level_group UNION ALL SELECT * FROM source_group UNION ALL SELECT * FROM branch_group)),
groups AS (SELECT key, label, group_rank, value, count, value_rank FROM fixed_groups
  UNION ALL SELECT key, label, group_rank, value, count, value_rank FROM ranked WHERE value_rank <= 50)
"""
SCOPE = "scope AS (SELECT * FROM log_events)"
FACETS = with_ctes(LOG_EVENTS, LEAVES, COUNTS)
GROUPS = with_ctes(LOG_EVENTS, LEAVES, COUNTS, SCOPE, RANKED)


def _add(name: str, run, sql: str | None) -> None:
    ENTRIES[name] = (run, sql)


def _leaf_rows(s: SparkSession, d: str) -> DataFrame:
    from emberlog.functions.values import text_of_variant

    return A.flatten_fields(wide_events(s, d)).select("id", "path", text_of_variant(F.col("v")).alias("text"))


_add("flatten_fields", _leaf_rows, with_ctes(LOG_EVENTS, LEAVES) + "SELECT id, path, text FROM leaves")
_add("level_facet", lambda s, d: A.level_facet(log_events(s, d)), with_ctes(LOG_EVENTS) + "SELECT level, count(*) AS count FROM log_events GROUP BY level")
_add("source_facet", lambda s, d: A.source_facet(log_events(s, d)),
     with_ctes(LOG_EVENTS) + "SELECT source, count(*) AS count FROM log_events GROUP BY source HAVING (SELECT count(DISTINCT source) FROM log_events) > 1")
_add("branch_facet", lambda s, d: A.branch_facet(log_events(s, d)),
     with_ctes(LOG_EVENTS) + "SELECT branch, count(*) AS count FROM log_events WHERE branch <> '' GROUP BY branch")
_add("producer_lists", lambda s, d: A.producer_lists(log_events(s, d)),
     with_ctes(LOG_EVENTS) + "SELECT DISTINCT 'source' AS kind, source AS name FROM log_events UNION SELECT DISTINCT 'branch', branch FROM log_events WHERE branch <> ''")
_add("field_facets", lambda s, d: A.field_facets(wide_events(s, d)).select("path", "value", "count"),
     FACETS + "SELECT path, value, count FROM counts WHERE path IN (SELECT path FROM paths)")
_add("field_facets_drop_nulls", lambda s, d: A.field_facets(wide_events(s, d), "drop").select("path", "value", "count"),
     FACETS + "SELECT path, value, count - nulls AS count FROM counts WHERE path IN (SELECT path FROM paths) AND count > nulls")
_add("rank_facets", lambda s, d: A.rank_facets(stage_table(A.value_counts(wide_events(s, d)))),
     GROUPS + "SELECT key, label, group_rank, value, count, value_rank FROM ranked WHERE value_rank <= 50")
_add("is_time_dimension", lambda s, d: A.first_values(wide_events(s, d)).select("path", A.is_time_dimension(F.col("path"), F.col("first_value")).alias("is_time")),
     with_ctes(LOG_EVENTS, LEAVES) + "SELECT DISTINCT path, path = 'created_at' AS is_time FROM leaves")
_add("detect_unix_ms", lambda s, d: log_events(s, d).select(
         "id", *[A.detect_unix_ms(F.lit(p), v).alias(n) for n, p, v in (
             ("as_ts", "meta.ts", F.col("ts").cast("string")), ("as_id", "user_id", F.col("ts").cast("string")),
             ("as_other", "when", (F.col("ts") * 2).cast("string")), ("far", "when", (F.col("ts") * 3).cast("string")))]),
     with_ctes(LOG_EVENTS) + "SELECT id, ts AS as_ts, CAST(NULL AS BIGINT) AS as_id, ts * 2 AS as_other, CASE WHEN ts * 3 <= 5000000000000 THEN ts * 3 END AS far FROM log_events")

SCOPED_TEXT = 'ts:>"2024-01-08" level:error ts:<=1705708800000 (ts:<5 OR path:/api/p1)'
_add("scoped_facets", lambda s, d: A.scoped_facets(wide_events(s, d), SCOPED_TEXT, now_ms=1_706_600_000_000),
     with_ctes(LOG_EVENTS, LEAVES.replace("FROM log_events e,", "FROM (SELECT * FROM log_events WHERE ts > 1704672000000 AND ts <= 1705708800000) e,"), COUNTS,
               "scope AS (SELECT * FROM log_events WHERE ts > 1704672000000 AND ts <= 1705708800000)",
               RANKED.replace("value, count, first_id,\n", "value, count - nulls AS count, first_id,\n").replace(
                   "ORDER BY count DESC, c.first_id, value) AS value_rank\n  FROM counts c JOIN ranked_paths r ON c.path = r.path WHERE group_rank <= 50",
                   "ORDER BY count - nulls DESC, c.first_id, value) AS value_rank\n  FROM counts c JOIN ranked_paths r ON c.path = r.path WHERE group_rank <= 50 AND count > nulls"))
     + "SELECT key, label, group_rank, value, count, value_rank FROM groups")
_add("search_facets", lambda s, d: A.search_facets(A.facet_groups(wide_events(s, d)), " P3 ").union(
         A.search_facets(A.facet_groups(wide_events(s, d)), "").filter("value_rank = 1")),
     GROUPS + """, hit AS (SELECT DISTINCT key FROM groups WHERE contains(lower(key), 'p3') OR contains(lower(label), 'p3') OR contains(lower(value), 'p3')),
     first7 AS (SELECT key FROM (SELECT DISTINCT key, group_rank FROM groups) ORDER BY group_rank, key LIMIT 7)
     SELECT * FROM groups WHERE key IN (SELECT key FROM hit) UNION ALL SELECT * FROM groups WHERE key IN (SELECT key FROM first7) AND value_rank = 1""")
_add("pretty_key", lambda s, d: A.flatten_fields(wide_events(s, d)).select("path").distinct().select("path", A.pretty_key(F.col("path")).alias("label")),
     with_ctes(LOG_EVENTS, LEAVES) + "SELECT DISTINCT path, array_to_string(list_transform(string_split(path, '.'), lambda x: upper(left(x, 1)) || substr(x, 2)), ' · ') AS label FROM leaves")
_add("numeric_facets", lambda s, d: A.numeric_facets(log_events(s, d)),
     with_ctes(LOG_EVENTS, LEAVES) + """, n AS (SELECT path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(text AS DOUBLE) END AS v FROM leaves)
     SELECT path, count(*) AS total, count(v) AS numeric, count(DISTINCT v) AS distinct_numbers FROM n
     WHERE NOT regexp_matches(path, '(?i)(^|\\.|_)(status|status_code|code|id|pid|port)$') GROUP BY path HAVING count(*) >= 16 AND count(v) / count(*) >= 0.8 AND count(DISTINCT v) >= 16""")
_add("percentile_stops", lambda s, d: A.percentile_stops(wide_events(s, d)),
     with_ctes(LOG_EVENTS, LEAVES) + """, n AS (SELECT path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(text AS DOUBLE) END AS v FROM leaves),
     r AS (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY path) AS n FROM n WHERE v IS NOT NULL)
     SELECT path, p, n, v AS value FROM r, (SELECT unnest([50.0, 75.0, 90.0, 95.0, 99.0]::DOUBLE[]) AS p) WHERE n >= 16 AND rn = least(n - 1, CAST(floor(p / 100 * n) AS BIGINT))""")


def _delta(s: SparkSession, d: str) -> DataFrame:
    events = wide_events(s, d)
    first, second, old = (F.col("ts") < 1_705_276_800_000), (F.col("ts") >= 1_705_276_800_000), (F.col("ts") < 1_704_672_000_000)
    return A.facet_delta(A.value_counts(events.filter(first)), events.filter(second), events.filter(old))


_add("facet_delta", _delta, FACETS + "SELECT path, value, count(*) AS count FROM kept WHERE ts >= 1704672000000 GROUP BY 1, 2")

_add("trigram_index", lambda s, d: S.trigram_index(log_events(s, d)),
     with_ctes(LOG_EVENTS) + """, m AS (SELECT msg, count(*) AS refs FROM log_events GROUP BY msg)
     SELECT DISTINCT substr(lower(msg), i, 3) AS gram, msg, refs FROM (SELECT msg, refs, unnest(range(1, length(msg) - 1)) AS i FROM m)""")
_add("search_messages", lambda s, d: S.search_messages(S.trigram_index(log_events(s, d)), "UP by User 1").union(
         S.search_messages(S.trigram_index(log_events(s, d)), "k ")),
     with_ctes(LOG_EVENTS) + """, m AS (SELECT msg, count(*) AS refs FROM log_events GROUP BY msg)
     SELECT msg, refs FROM m WHERE contains(msg, 'up by user 1') UNION ALL SELECT msg, refs FROM m WHERE contains(msg, 'k ')""")
_add("suggest_keys", lambda s, d: S.suggest_keys(A.value_counts(wide_events(s, d)), "S"),
     FACETS + """SELECT key, CASE WHEN left(key, 1) = 's' THEN 20.0 WHEN contains(key, '.s') THEN 10.0 ELSE 5.0 END::DOUBLE AS score
     FROM (SELECT DISTINCT path AS key FROM counts UNION SELECT unnest(['msg', 'raw', 'ts', 'level', 'source', 'branch'])) WHERE contains(key, 's')""")
SCORES = """,
  scored AS (SELECT path AS key, value, ln(1 + count) + 3 + CASE WHEN starts_with(lower(value), '{q}') THEN 10 ELSE 0 END AS score FROM counts
    WHERE contains(lower(value), '{q}')),
  best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, value) AS rn FROM scored) WHERE rn <= 2)"""
_add("suggest_values", lambda s, d: S.suggest_values(stage_table(A.value_counts(wide_events(s, d))), "P").withColumn("score", F.round("score", 6)),
     FACETS + SCORES.format(q="p") + " SELECT key, value, round(score, 6) AS score FROM best")
_add("suggest_messages", lambda s, d: S.suggest_messages(S.trigram_index(log_events(s, d)), "error by user 2").withColumn("score", F.round("score", 6)),
     with_ctes(LOG_EVENTS) + """SELECT msg, round(ln(1 + count(*)) + CASE WHEN starts_with(msg, 'error by user 2') THEN 6 ELSE 2 END, 6) AS score
     FROM log_events WHERE contains(msg, 'error by user 2') GROUP BY msg""")
_add("complete_keys", lambda s, d: S.complete_keys(A.facet_groups(wide_events(s, d)), "S", True).union(
         S.complete_keys(A.facet_groups(wide_events(s, d)), "").withColumn("rank", F.col("rank") + 100)),
     GROUPS + """, names AS (SELECT i AS ord, k AS key FROM (SELECT unnest(['msg', 'raw', 'ts', 'pinned', 'stack', 'hasStackTrace', 'relevant']) AS k, unnest(range(7)) AS i)
       UNION ALL SELECT DISTINCT group_rank + 1000, key FROM groups)
     (SELECT row_number() OVER (ORDER BY ord, key) AS rank, key FROM names WHERE starts_with(lower(key), 's') ORDER BY 1 LIMIT 8)
     UNION ALL (SELECT 100 + row_number() OVER (ORDER BY ord, key) AS rank, key FROM names WHERE key <> 'relevant' ORDER BY 1 LIMIT 8)""")
_add("complete_values", lambda s, d: S.complete_values(A.facet_groups(wide_events(s, d)), "path", "/API/"),
     GROUPS + "SELECT row_number() OVER (ORDER BY value_rank) AS rank, value FROM groups WHERE key = 'path' AND value_rank <= 50 AND starts_with(lower(value), '/api/') ORDER BY 1 LIMIT 8")


def _suggest(s: SparkSession, d: str) -> DataFrame:
    events = wide_events(s, d)
    found = S.suggest(A.value_counts(events), S.trigram_index(events), "er", 10)
    return found.withColumn("score", F.round("score", 6))


_add("suggest", _suggest, FACETS + SCORES.format(q="er") + """,
  keys AS (SELECT 'key' AS kind, key, NULL AS value, NULL AS msg, CASE WHEN starts_with(key, 'er') THEN 20.0 WHEN contains(key, '.er') THEN 10.0 ELSE 5.0 END AS score, key AS tie
    FROM (SELECT DISTINCT path AS key FROM counts UNION SELECT unnest(['msg', 'raw', 'ts', 'level', 'source', 'branch'])) WHERE contains(lower(key), 'er') ORDER BY score DESC, key LIMIT 3),
  msgs AS (SELECT 'msg' AS kind, NULL AS key, NULL AS value, msg, ln(1 + count(*)) + CASE WHEN starts_with(msg, 'er') THEN 6 ELSE 2 END AS score, msg AS tie
    FROM log_events WHERE contains(msg, 'er') GROUP BY msg ORDER BY score DESC, msg LIMIT 3),
  pairs AS (SELECT 'kv' AS kind, key, value, NULL AS msg, score, key || ':' || value AS tie, row_number() OVER (ORDER BY score DESC, key || ':' || value) AS rn FROM best),
  every AS (SELECT 0 AS g, * FROM keys UNION ALL SELECT 1, * EXCLUDE (rn) FROM pairs WHERE rn <= greatest(2, 10 - (SELECT count(*) FROM keys) - 3) UNION ALL SELECT 2, * FROM msgs)
  SELECT row_number() OVER (ORDER BY g, score DESC, tie) AS rank, kind, key, value, msg, round(score, 6) AS score FROM every ORDER BY 1 LIMIT 10""")
