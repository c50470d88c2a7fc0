"""Golden lines for parsing, levels and parse rules."""

import json

from pyspark.sql import functions as F

from emberlog.functions.levels import strip_ansi
from emberlog.functions.rule_table import BUILTIN_RULES
from emberlog.operators.normalise import drop_blank_events, is_stack_frame, parse_event
from emberlog.operators.rules import apply_parse_rules

PARSE = [
    ('{"level":"warn","msg":"hi","k":1}', "warn", "hi", {"level": "warn", "msg": "hi", "k": 1}),
    ('{"msg":"disk failure"}', "error", "disk failure", {"msg": "disk failure"}),
    ('{"level":"info","msg":"fatal crash"}', "error", "fatal crash", {"level": "info", "msg": "fatal crash"}),
    ('{"level":"debug","msg":"fatal crash"}', "debug", "fatal crash", {"level": "debug", "msg": "fatal crash"}),
    ('{"level":null,"severity":"error","msg":"x"}', "info", "x", {"level": None, "severity": "error", "msg": "x"}),
    ('{"level":50,"message":"m"}', "error", "m", {"level": 50, "message": "m"}),
    ('{"level":"30","msg":"m"}', "info", "m", {"level": "30", "msg": "m"}),
    ('{"lvl":20.9,"msg":"m"}', "debug", "m", {"lvl": 20.9, "msg": "m"}),
    ('{"msg":5,"message":"m"}', "info", "", {"msg": 5, "message": "m"}),
    ('{"a":1} tail', "info", '{"a":1} tail', None),
    ('{"a":1}{"b":2}', "info", '{"a":1}{"b":2}', None),
    ('{"a":1,"a":2}', "info", "", {"a": 2}),
    ("[1,2]", "info", "[1,2]", None),
    ('[be] {"msg":"m","tag":"own"}', "info", "m", {"msg": "m", "tag": "own"}),
    ('  [ fe ]{"msg":"m"}', "info", "m", {"msg": "m", "tag": "fe"}),
    ('[] {"msg":"m"}', "info", '[] {"msg":"m"}', None),
    ('{"level":"info","msg":"{\\"level\\":\\"warn\\",\\"msg\\":\\"in\\"}","h":1}', "warn", "in", {"level": "warn", "msg": "in", "h": 1}),
    ("\x1b[31mred\x1b[0m text", "error", "red text", None),
    ("\x1b[1;33mcareful\x1b[0m", "warn", "careful", None),
    ("\x1b[31mINFO\x1b[0m: fine", "info", "INFO: fine", None),
    ("see /var/error.log and --fail-fast", "info", "see /var/error.log and --fail-fast", None),
    ("head\r\n  error: tail", "error", "head", None),
    ("deprecated call", "warn", "deprecated call", None),
    ("verbose", "trace", "verbose", None),
]


def test_parse_event(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(PARSE)], "n int, line string")
    for r in parse_event(df).select("n", "level", "msg", F.to_json("fields").alias("f")).collect():
        line, level, msg, fields = PARSE[r["n"]]
        assert (r["level"], r["msg"], json.loads(r["f"]) if r["f"] else None) == (level, msg, fields), line


RULES = [
    ("k8s-klog", "W0102 03:04:05.678 17 main.go:42] low disk", "warn", "s", "low disk", {"file": "main.go:42", "thread": "17"}),
    ("java-log4j", "2024-01-02 03:04:05,678 ERROR [main] com.A - bad", "error", "com.A", "bad", {"thread": "main"}),
    ("python-logging", "2024-01-02 03:04:05,678 - app.db - CRITICAL - gone", "error", "app.db", "gone", None),
    ("android-logcat", "V/Tag( 12): hello", "trace", "s", "hello", {"tag": "Tag", "pid": "12"}),
    ("ios-nslog", "2024-01-02 03:04:05.678 App[1:0x2f] hi", "info", "App", "hi", {"pid": "1", "tid": "0x2f"}),
    ("rust-tracing-fmt", "2024-01-02T03:04:05.6Z  WARN app::db: slow", "warn", "app::db", "slow", None),
    ("rust-tracing", "[2024-01-02T03:04:05Z DEBUG app] x", "debug", "app", "x", None),
    ("syslog-rfc3164", "<34>Jan 12 06:30:00 box cron[9]: run", "info", "cron", "run", {"host": "box", "pid": "9"}),
    ("docker-cri", "2024-01-02T03:04:05Z stderr F out", "info", "s", "out", {"stream": "stderr"}),
    ("turbo", "@a/web:dev: ready", "info", "@a/web", "ready", {"script": "dev"}),
    ("nodemon", "[nodemon] restarting", "info", "s", "restarting", {"tag": "nodemon"}),
    ("workspace-path", "apps/web dev: ready", "info", "apps/web", "ready", {"script": "dev"}),
    ("level-prefix", "ERROR: no", "error", "s", "no", None),
    ("bracket-tag", "[db] open", "info", "s", "open", {"tag": "db"}),
    ("trailing-json", 'done {"a":{"b":1}} ', "info", "s", "done", {"a": {"b": 1}}),
    (None, '@a/web:dev: done {"n":2}', "info", "@a/web", "done", {"script": "dev", "n": 2}),
    (None, "@a/web:dev: ", "info", "@a/web", "@a/web:dev: ", {"script": "dev"}),
    (None, "bad json {nope}", "info", "s", "bad json", {}),
    (None, "just prose, nothing else", "info", "s", "just prose, nothing else", None),
]


def test_every_rule_has_a_case():
    assert {r["id"] for r in BUILTIN_RULES} == {c[0] for c in RULES if c[0]}


def test_apply_parse_rules(spark):
    df = spark.createDataFrame(
        [(i, "s", "info", c[1]) for i, c in enumerate(RULES)], "n int, source string, level string, msg string"
    ).withColumn("fields", F.lit(None).cast("variant"))
    for r in apply_parse_rules(df).select("n", "source", "level", "msg", F.to_json("fields").alias("f")).collect():
        _, line, level, source, msg, fields = RULES[r["n"]]
        assert (r["level"], r["source"], r["msg"]) == (level, source, msg), line
        want = None if fields is None else {**fields, "source": source, "level": level, "msg": msg}
        assert (json.loads(r["f"]) if r["f"] else None) == want, line


def test_unusable_rule_is_skipped(spark):
    df = spark.createDataFrame([("s", "info", "x")], "source string, level string, msg string").withColumn("fields", F.lit(None).cast("variant"))
    rules = [{"id": "bad", "order": 1, "pattern": "(", "output": {"msg": "no"}}, {"id": "ok", "order": 2, "pattern": "^(?<a>x)$", "flags": "i", "output": {"msg": "<${a}${zz}>"}}]
    assert apply_parse_rules(df, rules).first()["msg"] == "<x>"


def test_small_parts(spark):
    one = spark.createDataFrame([("a\x1b[1;31mb\x1bZc\x1b[9",)], "t string")
    assert one.select(strip_ansi(F.col("t"))).first()[0] == "abc"
    frames = ["at f (a.js:1:2)", "at src/a.rs:3", "at N.F() in C:\\a.cs:line 3", 'File "a.py", line 3', "from a.rb:1:in 'x'", "panic: x", "#0 0x1f in f", "#1 a.php(3): f"]
    plain = ["attack at dawn", "from here", "#1 thing"]
    rows = spark.createDataFrame([(t,) for t in frames + plain], "t string").select("t", is_stack_frame(F.col("t")).alias("y")).collect()
    assert {r["t"] for r in rows if r["y"]} == set(frames)
    blank = spark.createDataFrame([("", " "), ("x", " "), ("", "x")], "msg string, raw string").withColumn("fields", F.lit(None).cast("variant"))
    assert drop_blank_events(blank).count() == 2
