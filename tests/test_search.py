"""Filter text: reading, precedence, bounds, and what invalid text does."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators.predicates import parse_duration_ms, parse_moment
from emberlog.operators.search import FilterError, read_filter, scope_bounds, search, time_range_bounds

NOW = 1_706_600_000_000


def events(spark):
    rows = [
        (1, 10, "api", "", "error", "request mismatch", "raw one", '{"code":500,"user":{"id":1},"tags":["a"],"s":"x"}'),
        (2, 20, "web", "main", "info", "Query Result ok", "raw two", '{"code":"200","user":{"id":2}}'),
        (3, 30, "api", "main", "warn", "slow request", "raw three", None),
        (4, 40, "web", "dev", "error", "say \"hi\" (now)", "raw four", '{"code":null,"stack":"  at x"}'),
    ]
    df = spark.createDataFrame(rows, "id bigint, ts bigint, source string, branch string, level string, msg string, raw string, f string")
    return df.withColumn("fields", F.try_parse_json("f")).drop("f")


CASES = [
    ("", {1, 2, 3, 4}), ("request", {1, 3}), ("request mismatch", {1}), ('"query result"', {2}),
    ("level:error AND code:>=500", {1}), ("level:error OR source:web", {1, 2, 4}), ("NOT level:error", {2, 3}),
    ("NOT level:error request", {3}), ("level:error OR level:warn request", {1, 3, 4}), ("(level:error OR level:warn) request", {1, 3}),
    ("level: error", {1, 4}), ("code:*", {1, 2, 3, 4}), ("source:A*", {1, 3}), ("code:200", {2}), ("code:<1", {4}),
    ("code:undefined", {3}), ("NOT code:200", {1, 3, 4}), ("user.id:1", {1}), ("tags:a", {1}), ("tags.0:a", {1}),
    ("source~/^w.b$/", {2, 4}), ("source~/[/", set()), ("stack:true", {4}), ("hasStackTrace:false", {1, 2, 3}), ("ts:>=20 ts:<40", {2, 3}),
    ("timestamp:>30", {4}), ("raw:TWO", {2}), ("pinned:true", {3}), ("relevant:false", {1, 3, 4}), ('msg:"\\"hi\\""', {4}),
    ("ts:percentile(50)", {3, 4}), ("ts:<percentile(50)", {1, 2}), ("ts:last(1 h)", set()), ("ts:<last(1.5 h)", {1, 2, 3, 4}),
    ("missing:percentile(90)", set()), ("msg:", set()), ("say (now)", {4}), ("id:2", {2}),
    # without meaning: nothing is filtered
    ("(level:error", {1, 2, 3, 4}), ("level:error)", {1, 2, 3, 4}), ("AND", {1, 2, 3, 4}), ("ts:>soon", {1, 2, 3, 4}),
    ("ts:percentile(101)", {1, 2, 3, 4}), ("ts:last(3 parsecs)", {1, 2, 3, 4}), ("source~/abc", {1, 2, 3, 4}), ("()", {1, 2, 3, 4}),
]


def test_search(spark):
    df = events(spark).cache()
    pins = spark.createDataFrame([(3,), (99,)], "id bigint")
    relevant = spark.createDataFrame([(2,)], "id bigint")
    for text, want in CASES:
        got = {r["id"] for r in search(df, text, pins, relevant, NOW).collect()}
        assert got == want, text


def test_time_filter_reaches_the_scan(spark, tmp_path):
    events(spark).drop("fields").withColumn("fields", F.lit(None).cast("variant")).write.parquet(f"{tmp_path}/e")
    plan = search(spark.read.parquet(f"{tmp_path}/e"), "ts:>=20 level:error", now_ms=NOW)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,20)" in plan and "PushedFilters" in plan


@pytest.mark.parametrize("text", ["(a", "a)", "NOT", "a OR", "k:>", "k~/x"])
def test_no_meaning(text):
    with pytest.raises(FilterError):
        read_filter(text, NOW)


def test_bounds():
    assert time_range_bounds("ts:>5 (a OR ts:<=9) NOT ts:>=7", NOW) == (7, 9)
    assert scope_bounds("ts:>5 (a OR ts:<=9) NOT ts:>=7 (ts:<20 b) timestamp:>90", NOW) == (6, 19)
    assert scope_bounds("(broken", NOW) == (None, None)


def test_moments():
    assert parse_moment("14:02", NOW) == 1_706_623_320_000
    assert parse_moment("14:02:31.5", NOW) == 1_706_623_351_500
    assert parse_moment("Jan 12 14:30", NOW) == 1_705_069_800_000
    assert parse_moment("Feb 6", NOW) == 1_675_641_600_000  # not yet this year
    assert parse_moment("2024-01-10", NOW) == 1_704_844_800_000
    assert parse_moment("2024-01-10T06:00:00+02:00", NOW) == 1_704_859_200_000
    assert parse_moment("0x10", NOW) == 16 and parse_moment("soon", NOW) is None
    assert parse_duration_ms("1.5 min") == 90_000 and parse_duration_ms("2weeks") == 1_209_600_000 and parse_duration_ms("min") is None
