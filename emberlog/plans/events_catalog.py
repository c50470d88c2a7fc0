"""Registered queries over the log view: predicates, retrieval, correlation, histogram, stacks, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import alerts as A
from emberlog.operators import correlate as C
from emberlog.operators import histogram as H
from emberlog.operators import predicates as P
from emberlog.operators import retrieve as R
from emberlog.operators import search as S
from emberlog.operators import stacks as K
from emberlog.plans.fixture_sql import LOG_EVENTS, with_ctes
from emberlog.sources.fixtures import log_events, table

NOW_MS = 1_706_600_000_000  # 2024-01-30, the last day of the tables
LOG = with_ctes(LOG_EVENTS)
ENTRIES: dict = {}


def pins(spark: SparkSession, sf: str) -> DataFrame:
    """Pinned ids: every 97th event, plus as many ids that no event has any more."""
    ids = table(spark, sf, "events").filter("event_id % 97 = 0")
    return ids.select((F.col("event_id") + 1).alias("id")).union(ids.select((-F.col("event_id") - 1).alias("id")))


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id % 5 = 2").select((F.col("event_id") + 1).alias("id"))


PINS_SQL = "pins AS (SELECT event_id + 1 AS id FROM events WHERE event_id % 97 = 0 UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 97 = 0)"


def _filtered(name: str, condition, where: str) -> None:
    """A query that keeps the rows of a condition (a Column, or a function of the events)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        events = log_events(spark, sf)
        made = condition(events) if callable(condition) else condition
        return events.filter(made).select("id", "level", "msg")

    ENTRIES[name] = (run, LOG + f"SELECT id, level, msg FROM log_events WHERE {where}")


def _lazy(build):
    return lambda _events: build()


def threshold(percent: float, value: str = "dur_number") -> str:
    return (
        f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS rn, count(*) OVER () AS n "
        f"FROM log_events WHERE {value} IS NOT NULL) WHERE rn = least(n - 1, CAST(floor({percent} / 100.0 * n) AS BIGINT)))"
    )


_filtered("match_free", _lazy(lambda: P.match_free("BY USER 1")), "contains(lower(msg), 'by user 1')")
_filtered("match_exact", _lazy(lambda: P.match_exact("tags", "t1,z") | P.match_exact("user.id", "17") | P.match_exact("request_id", "undefined")),
          "(fields IS NOT NULL AND k % 3 = 1) OR (fields IS NOT NULL AND user_id = 17) OR request_id IS NULL")
_filtered("match_text", _lazy(lambda: P.match_text("raw", "\"PATH\":\"/API/P3") | P.match_text("msg", "Signup")),
          "contains(lower(coalesce(fields, msg)), '\"path\":\"/api/p3') OR contains(msg, 'signup')")
_filtered("match_glob", _lazy(lambda: P.match_glob("path", "/API/*3") | P.match_glob("request_id", "req_1*7")),
          "path = '/api/p3' OR (request_id LIKE 'req\\_1%7' ESCAPE '\\')")
_filtered("match_compare", _lazy(lambda: P.match_compare("dur_ms", "<", 50) | P.match_compare("value", ">=", 90.5)),
          "dur_number < 50 OR (fields IS NOT NULL AND value >= 90.5)")
_filtered("match_time", _lazy(lambda: P.match_time("ts", ">=", "2024-01-10T06:00:00", NOW_MS) & P.match_time("timestamp", "<", "Jan 12 14:30", NOW_MS)),
          "ts >= 1704866400000 AND ts < 1705069800000")
_filtered("match_regex", _lazy(lambda: P.match_regex("path", "p[0-2]$") | P.match_regex("msg", "^(click|view) by user \\d$")),
          "regexp_matches(coalesce(path, ''), 'p[0-2]$') OR regexp_matches(msg, '^(click|view) by user \\d$')")
_filtered("match_percentile", lambda e: P.match_percentile(e, "dur_ms", 90), f"dur_number >= {threshold(90)}")
_filtered("match_last", _lazy(lambda: P.match_last("ts", "1.5 days", NOW_MS)), f"ts >= {NOW_MS - 129_600_000}")
_filtered("match_has_stack", _lazy(lambda: P.match_has_stack()), "fields IS NOT NULL AND stack IS NOT NULL")
_filtered("match_and_or_not", _lazy(lambda: (P.match_exact("level", "error") | ~P.match_compare("status_code", "<", 404)) & ~P.match_free("user 3")),
          "(level = 'error' OR NOT (fields IS NOT NULL AND status_code < 404)) AND NOT contains(msg, 'user 3')")
_filtered("facet_select", _lazy(lambda: P.facet_select({"level": ["error", "warn"], "path": ["/api/p1", "/api/p4"]})),
          "level IN ('error', 'warn') AND path IN ('/api/p1', '/api/p4')")
_filtered("range_select", _lazy(lambda: P.range_select({"dur_ms": [(None, 100), (500, 600)], "k": [(5, None)]})),
          "(dur_number < 100 OR (dur_number >= 500 AND dur_number < 600)) AND fields IS NOT NULL AND k >= 5")
_filtered("percentile_select", lambda e: P.percentile_select(e, {"dur_ms": [75, 95], "value": [50]}),
          f"(dur_number >= {threshold(75)} OR dur_number >= {threshold(95)}) AND fields IS NOT NULL AND value >= {threshold(50, 'CASE WHEN fields IS NOT NULL THEN value END')}")
_filtered("exclude", _lazy(lambda: P.exclude("path", "/api/p2") & P.exclude("status_code", "5*")),
          "coalesce(path, '') <> '/api/p2' AND NOT (fields IS NOT NULL AND status_code = 500)")


def _search(name: str, text: str, where: str, ctes: str = "") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = S.search(log_events(spark, sf), text, pins(spark, sf), relevant(spark, sf), NOW_MS)
        return hits.select("id", "level", "msg")

    sql = with_ctes(LOG_EVENTS, ctes) if ctes else LOG
    ENTRIES[name] = (run, sql + f"SELECT id, level, msg FROM log_events WHERE {where}")


_search("search", '(level:error OR status_code:>=404) NOT path:"/api/p0" "by user 1" dur_ms:>=percentile(50)',
        f"(level = 'error' OR (fields IS NOT NULL AND status_code >= 404)) AND coalesce(path, '') <> '/api/p0' AND contains(msg, 'by user 1') AND dur_number >= {threshold(50)}")
_search("match_pinned", "pinned:true AND level~/^(error|view|trace)/",
        "id IN (SELECT id FROM pins) AND level IN ('error', 'trace')", PINS_SQL)
_search("match_relevant", "relevant:false level:warn", "user_id % 5 <> 2 AND level = 'warn'")


def _events(name: str, run, sql: str) -> None:
    ENTRIES[name] = (run, sql)


_events("recent", lambda s, d: R.recent(log_events(s, d), 300, "CLICK").select("id", "msg"),
        LOG + "SELECT id, msg FROM log_events WHERE contains(msg, 'click') ORDER BY id DESC LIMIT 300")
_events("since", lambda s, d: R.since(log_events(s, d), 400, 250).select("id", "ts", "source"),
        LOG + "SELECT id, ts, source FROM log_events WHERE id > 400 ORDER BY id LIMIT 250")
_events("cursor_status", lambda s, d: R.cursor_status(R.retain_newest(log_events(s, d), 600), 7),
        LOG + "SELECT min(id) AS min_id, count(*) AS live, 7 > 0 AND min(id) > 8 AS must_resync FROM log_events WHERE id > (SELECT max(id) FROM log_events) - 600")
def _retained(spark: SparkSession, sf: str) -> DataFrame:
    events = log_events(spark, sf)
    dropped = R.retention_report(events, 700).first()["dropped"]
    return R.retain_newest(events, 700).select("id", "level", F.lit(dropped).alias("dropped"))


_events("retain_newest", _retained,
        LOG + "SELECT id, level, (SELECT count(*) - least(count(*), 700) FROM log_events) AS dropped FROM log_events WHERE id > (SELECT max(id) FROM log_events) - 700")
_events("as_of", lambda s, d: R.as_of(log_events(s, d), 900).groupBy("level").agg(F.count("*").alias("n"), F.max("id").alias("last_id")),
        LOG + "SELECT level, count(*) AS n, max(id) AS last_id FROM log_events WHERE id <= 900 GROUP BY level")
_events("new_since_pause", lambda s, d: R.new_since_pause(log_events(s, d), 500, "dur_ms:>=percentile(75) level:error"),
        LOG + f"SELECT count(*) AS new_events FROM log_events WHERE id > 500 AND level = 'error' AND dur_number >= {threshold(75)}")
_events("order_events", lambda s, d: R.order_events(log_events(s, d)).select("id", "ts", "msg"),
        LOG + "SELECT id, ts, msg FROM log_events ORDER BY id DESC")
_events("newest_window", lambda s, d: R.newest_window(S.search(log_events(s, d), "level:error"), False).select("id", "msg"),
        LOG + "SELECT id, msg FROM (SELECT id, msg FROM log_events WHERE level = 'error' ORDER BY id DESC LIMIT 500) ORDER BY id")
_events("match_counts", lambda s, d: R.match_counts(log_events(s, d), P.match_exact("level", "error") & P.match_compare("k", ">", 50)),
        LOG + "SELECT count(*) AS total, count(*) FILTER (WHERE level = 'error' AND fields IS NOT NULL AND k > 50) AS filtered FROM log_events")
_events("project_fields", lambda s, d: R.project_fields(log_events(s, d), ["tags", "dur_ms", "user", "nope", "path"]).select(
            "id", "tags", "dur_ms", F.col("user").alias("user_cell"), "nope", "path"),
        LOG + """SELECT id, CASE WHEN fields IS NULL THEN '—' ELSE '[2]' END AS tags,
          CASE WHEN fields IS NULL OR dur = 'null' THEN '—' ELSE trim(dur, '"') END AS dur_ms,
          CASE WHEN fields IS NULL THEN '—' ELSE '{"id":' || user_id || '}' END AS user_cell, '—' AS nope, coalesce(path, '—') AS path FROM log_events""")
_events("list_pins", lambda s, d: R.list_pins(pins(s, d).union(pins(s, d))), with_ctes(PINS_SQL) + "SELECT DISTINCT id FROM pins ORDER BY id DESC")
_events("pins_status", lambda s, d: R.pins_status(pins(s, d), log_events(s, d)),
        with_ctes(LOG_EVENTS, PINS_SQL) + "SELECT p.id, e.id IS NOT NULL AS present, e.level, e.msg FROM (SELECT DISTINCT id FROM pins) p LEFT JOIN log_events e ON p.id = e.id")
_events("select_ids", lambda s, d: R.select_ids(log_events(s, d), pins(s, d)).select("id", "source", "msg"),
        with_ctes(LOG_EVENTS, PINS_SQL) + "SELECT id, source, msg FROM log_events WHERE id IN (SELECT id FROM pins)")
_events("apply_view", lambda s, d: R.apply_view(log_events(s, d), {"name": "slow writes", "query": "source:svc-1 branch:feature/* NOT level:trace"}).select("id", "branch", "level"),
        LOG + "SELECT id, branch, level FROM log_events WHERE source = 'svc-1' AND branch = 'feature/x' AND level <> 'trace'")
_events("agent_log_query", lambda s, d: R.agent_log_query(log_events(s, d), "signup", 9999),
        LOG + """, picked AS (SELECT * FROM log_events WHERE contains(msg, 'signup') ORDER BY id DESC LIMIT 9999)
        SELECT 0 AS ord, CASE WHEN count(*) = 0 THEN 'no events' ELSE count(*) || ' events (most recent first)' END AS text FROM picked
        UNION ALL SELECT id, '[' || id || '] ' || strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S')
          || CASE WHEN ts % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ts % 1000 AS VARCHAR), 3, '0') END || '+00:00 ' || rpad(level, 5, ' ') || ' ' || source || chr(10) || '  ' || msg FROM picked""")

_events("related_events", lambda s, d: C.related_events(log_events(s, d), 18).select("id", "msg", "shared_key", "shared_value"),
        LOG + "SELECT id, msg, 'request_id' AS shared_key, request_id AS shared_value FROM log_events WHERE id <> 18 AND request_id = (SELECT request_id FROM log_events WHERE id = 18)")
_events("correlate_all", lambda s, d: C.correlate_all(log_events(s, d)),
        LOG + "SELECT id, 'request_id' AS key, request_id AS value, n - 1 AS related FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM log_events WHERE request_id IS NOT NULL) WHERE n > 1")

_events("pick_bucket", lambda s, d: log_events(s, d).groupBy(F.floor(F.col("id") / 50).alias("slice")).agg((F.max("ts") - F.min("ts")).alias("range_ms")).select(
            "slice", "range_ms", H.pick_bucket(F.col("range_ms")).alias("bucket_ms")),
        LOG + "SELECT id // 50 AS slice, max(ts) - min(ts) AS range_ms, CASE " + " ".join(
            f"WHEN (max(ts) - min(ts)) / {b} <= 60 THEN {b}" for b in H.BUCKET_SIZES) + " ELSE 86400000 END AS bucket_ms FROM log_events GROUP BY 1")

HISTOGRAM_SQL = """, hits AS ({hits}),
  span AS (SELECT min(ts) AS lo, CASE WHEN max(ts) = min(ts) THEN max(ts) + 1 ELSE max(ts) END AS hi FROM hits),
  sized AS (SELECT *, CASE """ + " ".join(f"WHEN (hi - lo) / {b} <= 60 THEN {b}" for b in H.BUCKET_SIZES) + """ ELSE 86400000 END AS size FROM span),
  aligned AS (SELECT size, lo // size * size AS start, greatest(1, (hi + 1 + size - 1) // size - lo // size) AS n FROM sized),
  padded AS (SELECT size, greatest(n, 24) AS n, start - greatest(0, 24 - n) // 2 * size AS start FROM aligned),
  grid AS (SELECT start + i * size AS ts, size FROM padded, range(0, 100000) r(i) WHERE i < n)
  SELECT g.ts, count(*) FILTER (WHERE level = 'error') AS err, count(*) FILTER (WHERE level = 'warn') AS warn,
    count(*) FILTER (WHERE level NOT IN ('error', 'warn')) AS rest, count(h.ts) AS total
  FROM grid g LEFT JOIN hits h ON h.ts // g.size * g.size = g.ts GROUP BY g.ts"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return H.histogram(S.search(log_events(spark, sf), "level:error AND k:>=50"))


_events("search_histogram", flagship, LOG + HISTOGRAM_SQL.format(hits="SELECT * FROM log_events WHERE level = 'error' AND fields IS NOT NULL AND k >= 50"))
_events("histogram", lambda s, d: H.histogram(log_events(s, d)), LOG + HISTOGRAM_SQL.format(hits="SELECT * FROM log_events"))


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = S.time_range_bounds('ts:>"2024-01-05" (level:error OR ts:<="2024-01-20T12:00:00") NOT ts:<1706000000000', NOW_MS)
    events = log_events(spark, sf)
    return events.filter(F.col("ts").between(int(lo), int(hi))).select("id", "ts", "level")


_events("time_range_bounds", _bounded, LOG + "SELECT id, ts, level FROM log_events WHERE ts BETWEEN 1704412800000 AND 1705752000000")

_events("extract_stack", lambda s, d: K.extract_stack(log_events(s, d)).select("id", F.col("idx").cast("bigint").alias("idx"), "frame"),
        LOG + """SELECT id, unnest([0, 1]) AS idx, unnest(['at run (src/app' || (user_id % 5) || '.ts:' || (k + 1) || ':7)', 'at src/main.ts:3']) AS frame
        FROM log_events WHERE fields IS NOT NULL AND stack IS NOT NULL""")
_events("parse_frames", lambda s, d: K.parse_frames(K.extract_stack(log_events(s, d))).select("id", "frame", "fn", "file", "line", F.col("col").alias("col_no")),
        LOG + """SELECT id, 'at run (src/app' || (user_id % 5) || '.ts:' || (k + 1) || ':7)' AS frame, 'run' AS fn, 'src/app' || (user_id % 5) || '.ts' AS file, k + 1 AS line, 7 AS col_no
        FROM log_events WHERE fields IS NOT NULL AND stack IS NOT NULL
        UNION ALL SELECT id, 'at src/main.ts:3', NULL, 'src/main.ts', 3, NULL FROM log_events WHERE fields IS NOT NULL AND stack IS NOT NULL""")

RULES = [
    {"id": "a-err", "name": "Errors", "query": "level:error", "color": "red", "notify": True, "debounce_ms": 60_000, "enabled": True},
    {"id": "b-off", "name": "Disabled", "query": "level:warn", "color": "blue", "notify": True, "debounce_ms": 0, "enabled": False},
    {"id": "c-bad", "name": "Broken", "query": "(level:warn", "color": "blue", "notify": True, "debounce_ms": 0, "enabled": True},
    {"id": "d-slow", "name": "Slow", "query": "dur_ms:>=percentile(95)", "color": "violet", "notify": False, "debounce_ms": 0, "enabled": True},
    {"id": "e-500", "name": "Failures", "query": "status_code:500 OR path:/api/p3", "color": "orange", "notify": True, "debounce_ms": 3_600_000, "enabled": True},
]
PLAIN_RULES = [r for r in RULES if "percentile" not in r["query"]]
ALERT_IDS = (
    "array_to_string(list_filter([CASE WHEN level = 'error' THEN 'a-err' END, CASE WHEN dur_number >= {t} THEN 'd-slow' END, "
    "CASE WHEN fields IS NOT NULL AND (status_code = 500 OR path = '/api/p3') THEN 'e-500' END], lambda x: x IS NOT NULL), ',')"
).format(t=threshold(95))
PLAIN_IDS = (
    "array_to_string(list_filter([CASE WHEN level = 'error' THEN 'a-err' END, "
    "CASE WHEN fields IS NOT NULL AND (status_code = 500 OR path = '/api/p3') THEN 'e-500' END], lambda x: x IS NOT NULL), ',')"
)


def _rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored alert rules of mixed quality, one per part."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit('{"id":"r'), k.cast("string"), F.lit('"'),
        F.when(k % 7 != 0, F.concat(F.lit(',"name":"n'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.when(k % 5 != 0, F.lit(',"query":"level:error"')).otherwise(F.lit(',"query":5')),
        F.when(k % 3 == 0, F.lit(',"color":"blue"')).otherwise(""),
        F.when(k % 2 == 0, F.lit(',"notify":true')).otherwise(F.lit(',"notify":"yes"')),
        F.when(k % 4 != 0, F.concat(F.lit(',"debounce_ms":'), (k * 10).cast("string"))).otherwise(F.lit(',"debounce_ms":"soon"')),
        F.when(k % 6 == 0, F.lit(',"enabled":false')).otherwise(""),
        F.lit(',"created_at":'), k.cast("string"), F.lit("}"),
    )
    return table(spark, sf, "part").select(F.parse_json(text).alias("rule"))


_events("normalise_alert_rules", lambda s, d: A.normalise_alert_rules(_rule_rows(s, d), now_ms=NOW_MS),
        """SELECT 'r' || p_partkey AS id, 'n' || p_partkey AS name, 'level:error' AS query, CASE WHEN p_partkey % 3 = 0 THEN 'blue' ELSE 'red' END AS color,
        p_partkey % 2 = 0 AS notify, CASE WHEN p_partkey % 4 <> 0 THEN greatest(p_partkey * 10, 5000) ELSE 5000 END AS debounce_ms,
        p_partkey % 6 <> 0 AS enabled, p_partkey AS created_at FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0""")
_events("match_alerts", lambda s, d: A.match_alerts(log_events(s, d), RULES, NOW_MS).select("id", F.array_join("alert_ids", ",").alias("alert_ids")),
        LOG + f"SELECT id, {ALERT_IDS} AS alert_ids FROM log_events WHERE {ALERT_IDS} <> ''")
_events("primary_alert", lambda s, d: A.primary_alert(A.match_alerts(log_events(s, d), RULES, NOW_MS), RULES),
        LOG + f"""SELECT id, split_part(a, ',', 1) AS alert_id, CASE split_part(a, ',', 1) WHEN 'a-err' THEN 'red' WHEN 'd-slow' THEN 'violet' ELSE 'orange' END AS color
        FROM (SELECT id, {ALERT_IDS} AS a FROM log_events) WHERE a <> ''""")


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    events = log_events(spark, sf)
    cut = F.col("ts") < 1_705_276_800_000  # the first half month was matched before
    earlier = A.match_alerts(events.filter(cut), RULES, NOW_MS)
    merged = A.match_alerts_delta(earlier, events.filter(~cut), events, RULES, NOW_MS)
    return merged.select("id", F.array_join("alert_ids", ",").alias("alert_ids"))


_events("match_alerts_delta", _delta, ENTRIES["match_alerts"][1])
# The gate keeps state from match to match, so the SQL twin walks the matches one by one.
_events(
    "alert_fires",
    lambda s, d: A.alert_fires(A.match_alerts(log_events(s, d), RULES, NOW_MS), RULES),
    "WITH RECURSIVE " + LOG.strip()[5:] + """,
    hits AS (
      SELECT row_number() OVER (ORDER BY id, ord) AS n, * FROM (
        SELECT id, ts, msg, 1 AS ord, 'a-err' AS alert_id FROM log_events WHERE level = 'error'
        UNION ALL SELECT id, ts, msg, 2, 'e-500' FROM log_events WHERE fields IS NOT NULL AND (status_code = 500 OR path = '/api/p3'))),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS n, CAST(-1e15 AS BIGINT) AS la, CAST(-1e15 AS BIGINT) AS le, CAST(0 AS BIGINT) AS sa, CAST(0 AS BIGINT) AS se,
             false AS fired, CAST(0 AS BIGINT) AS suppressed
      UNION ALL
      SELECT n, CASE WHEN fire AND is_a THEN ts ELSE la END, CASE WHEN fire AND NOT is_a THEN ts ELSE le END,
             CASE WHEN is_a THEN CASE WHEN fire THEN 0 ELSE sa + 1 END ELSE sa END,
             CASE WHEN NOT is_a THEN CASE WHEN fire THEN 0 ELSE se + 1 END ELSE se END,
             fire, CASE WHEN is_a THEN sa ELSE se END
      FROM (SELECT h.n, h.ts, w.la, w.le, w.sa, w.se, h.alert_id = 'a-err' AS is_a,
              h.ts - greatest(w.la, w.le) >= 5000 AND h.ts - CASE WHEN h.alert_id = 'a-err' THEN w.la ELSE w.le END
                >= CASE WHEN h.alert_id = 'a-err' THEN 60000 ELSE 3600000 END AS fire
            FROM walk w JOIN hits h ON h.n = w.n + 1))
    SELECT h.id, h.alert_id, h.ts, w.suppressed, CASE h.alert_id WHEN 'a-err' THEN 'Errors' ELSE 'Failures' END AS title,
      left(h.msg, 120) || CASE WHEN w.suppressed > 0 THEN chr(10) || '+' || w.suppressed || ' more' ELSE '' END AS body
    FROM walk w JOIN hits h ON h.n = w.n WHERE w.fired""",
)
