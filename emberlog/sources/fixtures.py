"""Log-shaped views of the given tables, in Spark; :mod:`emberlog.plans.fixture_sql` has the SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.values import once
from emberlog.session import prepare, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_event_columns(events: DataFrame) -> DataFrame:
    """The log view of the ``events`` table (batch or streaming), payload still as JSON text."""
    e, u = F.col("event_id"), F.col("user_id")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    dur = (
        F.when(e % 17 == 0, F.lit("null"))
        .when(e % 13 == 0, F.concat(F.lit('"'), (k * 10).cast("string"), F.lit('"')))
        .otherwise((k * 10).cast("string"))
    )
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 201, 304, 404, 500)]), (e % 5).cast("int") + 1)

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    payload = text(
        '{"event_type":"', F.col("event_type"), '","user":{"id":', u, '},"k":', k, ',"value":', F.col("value"),
        ',"status_code":', status, ',"path":"/api/p', u % 7, '"',
        F.when(e % 7 != 0, text(',"request_id":"req_', F.floor(e / 3), '"')).otherwise(""),
        ',"dur_ms":', dur, ',"tags":["t', k % 3, '","z"],"created_at":', F.col("_ms"),
        F.when(
            F.col("event_type") == "error",
            text(',"stack":["at run (src/app', u % 5, '.ts:', k + 1, ':7)","at src/main.ts:3"]'),
        ).otherwise(""),
        "}",
    )
    level = F.element_at(
        F.create_map(
            *[F.lit(x) for pair in (("error", "error"), ("purchase", "warn"), ("signup", "info"),
                                    ("click", "debug"), ("view", "trace")) for x in pair]
        ),
        F.col("event_type"),
    )
    branch = F.when(u % 3 == 0, F.lit("")).when(u % 3 == 1, F.lit("main")).otherwise(F.lit("feature/x"))
    base = events.withColumn("_ms", ts)
    return base.select(
        (e + 1).alias("id"),
        F.col("_ms").alias("ts"),
        F.concat(F.lit("svc-"), (u % 4).cast("string")).alias("source"),
        branch.alias("branch"),
        level.alias("level"),
        F.concat(F.col("event_type"), F.lit(" by user "), u.cast("string")).alias("msg"),
        F.when(e % 11 != 0, payload).alias("payload"),
    )


def as_log_events(viewed: DataFrame) -> DataFrame:
    """Turn the JSON text payload into ``raw`` and the VARIANT ``fields``, parsed once per row."""
    columns = ("id", "ts", "source", "branch", "level", "msg")
    named = viewed.select(*columns, F.coalesce("payload", "msg").alias("raw"), "payload")
    return once(named, {"fields": F.try_parse_json("payload")}).select(*columns, "raw", "fields")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log_events(with_event_columns(spread(table(spark, sf_dir, "events"))))


def line_shapes(events: DataFrame) -> DataFrame:
    """Unparsed lines of the ``events`` table: one of twenty shapes per event, one row per line.

    ``ord`` orders all lines of all sources by arrival; it is unique and, per source, increasing.
    """
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    kind, clock = F.col("event_type"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    msg = text(kind, " by user ", u)
    shapes = {
        0: [text('{"level":"warn","msg":"', msg, '","k":', k, "}")],
        1: [text('[be] {"level":"error","msg":"', msg, '","k":', k, "}")],
        2: [text('{"level":"info","msg":"{\\"level\\":\\"debug\\",\\"msg\\":\\"inner ', kind, '\\",\\"pid\\":', u, '}","host":"h1"}')],
        3: [text('{"host":"h2","body":"{\\"msg\\":\\"body ', kind, ' failed\\",\\"reqId\\":', k, '}"}')],
        4: [text('{"level":', (k % 6 + 1) * 10, ',"time":', ms, ',"msg":"', msg, '"}')],
        5: [text('{"msg":"', msg, ' crashed","k":', k, "}")],
        6: [F.lit("{"), text('  "level": "', kind, '",'), text('  "msg": "pretty ', kind, ' {", '), text('  "k": ', k), F.lit("}")],
        7: [text("W0102 03:04:05.678 ", u, " main.go:", k, "] klog ", kind)],
        8: [text(clock, ",123 ERROR [worker-", k % 4, "] com.acme.Svc", k % 5, " - java ", kind)],
        9: [text(clock, ",123 - app.mod", k % 3, " - WARNING - py ", kind)],
        10: [text("[2024-01-01T00:00:00Z DEBUG crate::m", k % 3, "] env ", kind)],
        11: [text("<34>Jan 12 06:30:00 host", u % 4, " cron[", k, "]: sys ", kind)],
        12: [text("2024-01-01T00:00:00.1Z stderr F cri ", kind)],
        13: [text("@acme/web:dev: turbo ", kind, " ", k)],
        14: [text("\x1b[33m", kind, "\x1b[0m coloured ", k)],
        15: [text("ERROR: prefixed ", kind, " ", k)],
        16: [text("TypeError: bad ", kind), F.lit("    at run (app.js:10:5)"), F.lit("    at main (app.js:20:1)"), F.lit("  at tail")],
        17: [text("error: first ", kind), text("error: second ", k)],
        18: [text("done ", kind, ' {"k":', k, ',"user":{"id":', u, "}}")],
        19: [text("plain prose about ", kind), F.lit("   ")],
    }
    lines = F.array(F.lit(""))
    for shape, parts in shapes.items():
        lines = F.when(e % 20 == shape, F.array(*parts)).otherwise(lines)
    branch = F.when(u % 3 == 0, F.lit("")).when(u % 3 == 1, F.lit("main")).otherwise(F.lit("feature/x"))
    return events.select(
        F.concat(F.lit("svc-"), (u % 4).cast("string")).alias("source"),
        branch.alias("branch"),
        e.alias("_e"), ms.alias("arrival_ms"), F.posexplode(lines).alias("_p", "line"),
    ).select(
        "source", "branch", (F.col("_e") * 10 + F.col("_p")).alias("seq"), "arrival_ms", "line"
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_shapes(spread(table(spark, sf_dir, "events")))


def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents.text`` as log lines: source, seq and line, in document and line order."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "source", F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).select("source", F.lit("").alias("branch"), (F.col("doc_id") * 100000 + F.col("pos")).alias("seq"), "line")
