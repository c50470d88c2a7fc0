"""Inputs past the limits that operators once had."""

import re

import pytest
from pyspark.sql import functions as F

from emberlog import session
from emberlog.functions.levels import level_from_ansi
from emberlog.functions.values import number_of_text, text_of_variant
from emberlog.operators.codesites import code_slice, emission_sites, string_literals
from emberlog.operators.facets import first_values, numeric_facets, producer_lists
from emberlog.operators.grams import rarest_part
from emberlog.operators.relevance import expand_barrels, match_relevance
from emberlog.operators.retrieve import agent_log_query, retain_newest
from emberlog.operators.rules import extract_body
from emberlog.operators.search import FilterError, read_filter
from emberlog.operators.suggest import suggest_values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "json,text", [("[[[1,2]]]", "1,2"), ("[[[[5]]]]", "5"), ("[[],1,[null,[2,[]]]]", ",1,,2,"), ('["a[[",["b"]]', "a[[,b"), ("[]", "")]
)
def test_arrays_of_any_nesting(spark, json, text):
    assert one(spark, text_of_variant(F.parse_json(F.lit(json)))) == text


def test_long_numbers_in_other_bases(spark):
    assert one(spark, number_of_text(F.lit("0x" + "f" * 20))) == float(16**20 - 1)
    assert one(spark, number_of_text(F.lit("0b" + "1" * 120))) == float(2**120 - 1)


def test_filters_of_any_nesting():
    deep = read_filter("(" * 3000 + "a OR b" + ")" * 3000 + " NOT c")
    truth = lambda on: deep.over(lambda leaf: _Bool(leaf.value in on)).value
    assert truth({"a"}) and truth({"b"}) and not truth({"a", "c"}) and not truth(set())
    mixed = read_filter("a OR b AND NOT c")
    assert mixed.over(lambda leaf: _Bool(leaf.value in {"a", "c"})).value
    for bad in ("(a", "a)", "a AND", "OR b", "NOT", "()"):
        with pytest.raises(FilterError):
            read_filter(bad)


class _Bool:
    def __init__(self, value):
        self.value = value

    def __and__(self, other):
        return _Bool(self.value and other.value)

    def __or__(self, other):
        return _Bool(self.value or other.value)

    def __invert__(self):
        return _Bool(not self.value)


def test_lines_of_a_megabyte_do_not_end_the_jvm(spark):
    colours = F.concat(F.lit("\x1b["), F.repeat(F.lit("1;"), 500_000))
    assert one(spark, level_from_ansi(colours)) is None
    assert one(spark, level_from_ansi(F.concat(colours, F.lit("31m")))) == "error"
    path = F.concat(F.lit("@a"), F.repeat(F.lit("/b"), 500_000))
    assert one(spark, extract_body(F.concat(path, F.lit(" dev: hello")))) == "hello"
    assert len(one(spark, extract_body(path))) == 1_000_002
    line = F.concat(F.lit('x("'), F.repeat(F.lit('ab\\"'), 250_000), F.lit('")'))
    rows = spark.range(1).select(F.lit("r").alias("root"), F.lit("p").alias("path"), F.lit(1).alias("line"), line.alias("text"))
    assert string_literals(rows).select(F.length("literal")).collect()[0][0] == 1_000_000


@pytest.mark.parametrize("codes,level", [("31", "error"), ("1;33", "warn"), ("131", None), (";31", None), ("31;;1", None), ("0;91;4", "error")])
def test_colour_sequences(spark, codes, level):
    assert one(spark, level_from_ansi(F.lit(f"a \x1b[{codes}m b"))) == level


@pytest.mark.parametrize("text,body", [("a/b dev: x", "x"), ("@s/a/b-c dev: x", "x"), ("a//b dev: x", None), ("a/ dev: x", None), ("a dev: x", None)])
def test_workspace_paths(spark, text, body):
    assert one(spark, extract_body(F.lit(text))) == (body or text)


def test_whole_tables_are_looked_at(spark):
    events = spark.range(1, 6001).select(
        (F.col("id") * 2).alias("id"), F.lit(0).cast("bigint").alias("ts"), F.concat(F.lit("s"), F.col("id") % 90).alias("source"),
        F.lit("b").alias("branch"), F.lit("info").alias("level"), F.lit("m").alias("msg"), F.lit("m").alias("raw"),
        F.parse_json(F.concat(F.lit('{"n":'), F.when(F.col("id") < 3000, F.col("id").cast("string")).otherwise('"x"'), F.lit("}"))).alias("fields"),
    )
    assert agent_log_query(events, limit=5500).count() == 5501
    assert [r.id for r in retain_newest(events, 3).orderBy("id").collect()] == [11996, 11998, 12000]
    assert retain_newest(events.limit(0), 3).collect() == []
    assert producer_lists(events).filter("kind = 'source'").count() == 90
    assert numeric_facets(events).collect() == [] and len(numeric_facets(events.filter("id < 6000"), newest=50).collect()) == 1


def test_long_barrel_chains_and_wide_paths(spark):
    links = spark.createDataFrame([("r", f"m{i}", f"src/m{i + 1}.ts") for i in range(6)], "root string, module string, path string")
    start = spark.createDataFrame([("r", "m0", "src/m0.ts")], "root string, module string, origin string")
    assert {r.module for r in expand_barrels(start, links).collect()} == {f"m{i}" for i in range(7)}
    counts = spark.range(1500).select(F.lit("user").alias("path"), F.concat(F.lit("id-"), "id").alias("value"), F.lit(1).alias("count"))
    assert [r.value for r in suggest_values(counts, "id-1499").collect()] == ["id-1499"]


def test_code_context_as_asked(spark):
    files = spark.createDataFrame([("r", "a.ts", "\n".join(map(str, range(100))))], "root string, path string, content string")
    assert code_slice(files, "a.ts", 50, 40).count() == 81


def test_patterns_and_texts_meet_on_words_few_patterns_share(spark):
    """However many patterns there are, a part of few of them is looked up, and every match is still found."""
    calls = [["java job p%d took" % k, "seconds"] for k in range(300)] + [["ab"], ["of the x"], ["of the y"]]
    calls += [["of the %s end" % w] for w in ("one", "two")] + [["see\tP7 now"], ["in", "out ſ3"]]
    quoted = [".*?".join(re.escape(p) for p in c) for c in calls]
    needles = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "needle long, pieces array<string>")
    parts = {r.needle: r.gram for r in rarest_part(needles, "needle", F.transform("pieces", lambda p: F.lower(p))).collect()}
    assert [parts[k] for k in range(300)] == ["word:p%d" % k for k in range(300)] and set(parts) == set(range(len(calls)))
    rows = [("s", f"f{i % 9}", i, f"c{i}", c, q, "direct" if i % 2 else "indirect") for i, (c, q) in enumerate(zip(calls, quoted))]
    rows += [("s", "f0", 0, "a copy", calls[5], quoted[5], "direct"), ("t", "f1", 1, "other", calls[6], quoted[6], "direct")]
    schema = "source string, rel_path string, line long, raw_call string, pieces array<string>, regex string, kind string"
    texts = ["xjava JOB p5 took 3 seconds", "java job p51 took 9 seconds", "java job p5 took", "cab", "of the xy", "OF THE ONE END", "see\tp7 nowhere",
             "in and out S3", "of the two  end", None, "", "java job p299 took seconds, ab"]
    events = spark.createDataFrame(
        [(i, "stu"[i % 3], a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "id long, source string, msg string, raw string")
    want = {}
    for e in events.collect():
        for text in (e.msg, e.raw):
            hits = [(m.start(), r[6] != "direct", r[1], r[2], r[3], r[6]) for r in rows
                    if r[0] == e.source and text is not None and (m := re.search(r[5], text, re.I))]
            if hits and e.id not in want:
                want[e.id] = min(hits)[2:]
    got = match_relevance(events, spark.createDataFrame(rows, schema))
    assert {r.id: (r.rel_path, r.line, r.raw_call, r.kind) for r in got.collect()} == want and len(want) > 20


def test_emission_sites_broadcast_no_literals(spark):
    """Literals are looked up by the few grams of the needles; the tables themselves are not sent around."""
    events = spark.createDataFrame([(1, "s", "java job 1 x"), (2, "s", "nothing alike here"), (3, "t", "java job 1 x")], "id long, source string, msg string")
    files = spark.createDataFrame([("/r", "a.java", 'x\nlog("java job p1");\n'), ("/r", "b.java", 'log("a java job");')], "root string, path string, content string")
    roots = spark.createDataFrame([("s", "/r")], "source string, root string")
    found = emission_sites(events, files, roots)
    assert [tuple(r) for r in found.collect()] == [(1, "a.java", 2)]
    assert "literal" not in found._jdf.queryExecution().toString()  # the lookup is over when the log is joined
    assert emission_sites(events, files.limit(0), roots).collect() == []


def test_first_values_need_no_sort(spark):
    rows = [(3, '{"a":1,"b":{"c":"x"}}'), (1, '{"a":"first"}'), (1, '{"a":"first"}'), (None, '{"d":5}'), (2, None)]
    events = spark.createDataFrame(rows, "id long, j string").select("id", F.try_parse_json("j").alias("fields"))
    found = first_values(events)
    assert {(r.path, r.first_value) for r in found.collect()} == {("a", '"first"'), ("b.c", '"x"'), ("d", None)}


def test_many_rows_are_spread(spark, tmp_path, monkeypatch):
    """Tasks get a bounded number of rows, whatever the row groups of the files."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    spark.range(5000).repartition(1).write.parquet(f"{tmp_path}/t")
    dealt = session.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert dealt.rdd.getNumPartitions() >= 50 and dealt.count() == dealt.distinct().count() == 5000


def test_barrels_expand_only_what_is_new(spark):
    """A ring and a long chain of re-exports end with every origin everywhere it is handed on."""
    edges = [(f"m{i}", f"src/m{i + 1}.ts") for i in range(12)] + [("m12", "src/m10.ts")]
    reexports = spark.createDataFrame([("/r", p, m) for m, p in edges], "root string, path string, module string")
    origins = spark.createDataFrame([("/r", "m0", "o"), ("/r", "m11", "p"), ("/q", "m0", "q")], "root string, module string, origin string")
    got = sorted(tuple(r) for r in expand_barrels(origins, reexports).collect())
    assert got == sorted([("/r", f"m{i}", "o") for i in range(13)] + [("/r", m, "p") for m in ("m10", "m11", "m12")] + [("/q", "m0", "q")])
