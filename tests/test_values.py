"""Text and number forms of dynamic values."""

import math

import pytest
from pyspark.sql import functions as F

from emberlog.functions.dialect import ecma, group_numbers
from emberlog.functions.values import lookup_path, number_of_text, number_of_variant, text_of_variant

NAN = float("nan")
FORMS = [
    ("1e3", "1000", 1000.0), ("200.0", "200", 200.0), ("12.50", "12.5", 12.5), ("0.0000001", "1e-7", 1e-7),
    ("1e21", "1e+21", 1e21), ("-0", "0", 0.0), ("null", "null", 0.0), ("true", "true", 1.0), ('"a"', "a", NAN),
    ("[]", "", 0.0), ("[5]", "5", 5.0), ('[1,null,[2,3],"x"]', "1,,2,3,x", NAN), ('{"a":1}', "[object Object]", NAN),
    ('" 7 "', " 7 ", 7.0), ('"0x1F"', "0x1F", 31.0), ("[[7]]", "7", 7.0), ('"true"', "true", NAN), ('""', "", 0.0),
    ("[null]", "", 0.0), ('"1e3"', "1e3", 1000.0), ('"[x"', "[x", NAN), ("12345678901234567", "12345678901234568", 12345678901234568.0),
]


def test_forms(spark):
    rows = spark.createDataFrame([(j,) for j, _, _ in FORMS], "j string").select("j", F.parse_json("j").alias("v"))
    got = {r[0]: (r[1], r[2]) for r in rows.select("j", text_of_variant(F.col("v")), number_of_variant(F.col("v"))).collect()}
    for j, text, number in FORMS:
        assert got[j][0] == text, j
        assert (math.isnan(number) and math.isnan(got[j][1])) or got[j][1] == number, j


@pytest.mark.parametrize("text,number", [("", 0.0), ("1d", NAN), (".5", 0.5), ("5.", 5.0), ("0b101", 5.0), ("0o17", 15.0), ("-Infinity", -math.inf), ("x", NAN)])
def test_number_of_text(spark, text, number):
    got = spark.range(1).select(number_of_text(F.lit(text))).first()[0]
    assert got == number or (math.isnan(got) and math.isnan(number))


def test_paths(spark):
    payload = '{"a":{"b":[10,{"c":"x"}],"0":"zero"},"a.b":1,"length":7}'
    df = spark.createDataFrame([(payload,)], "p string").select(F.parse_json("p").alias("fields"))
    want = {"a.b.0": "10", "a.b.1.c": "x", "a.b.length": "2", "a.0": "zero", "length": "7", "a.b.c": "undefined", "nope": "undefined"}
    row = df.select(*[lookup_path(k).text().alias(k.replace(".", "_")) for k in want]).first()
    assert {k: row[k.replace(".", "_")] for k in want} == want


def test_dialect(spark):
    assert group_numbers(r"^(?<a>x)(?:y)([(])(?<b>\(z\))$") == {"a": 1, "b": 3}
    p = ecma(r"^(?<w>\S+)\s$")
    rows = spark.createDataFrame([("a ",), ("a\u00a0",), ("a \n",)], "t string").select(F.col("t").rlike(p)).collect()
    assert [r[0] for r in rows] == [True, True, False]
