"""Stack traces carried by events, and their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.dialect import ecma
from emberlog.functions.values import STACK_KEYS

# Shapes of a frame inside free text and of a parsed frame.
_IN_TEXT = r"\bat\s+\S.*?:\d+:\d+"
_CALL = r"^(.+?)\s+\((.+?):(\d+)(?::(\d+))?\)$"
_PLACE = r"^(.+?):(\d+)(?::(\d+))?$"


def stack_lines(fields: Column, msg: Column, raw: Column) -> Column:
    """Frames of the first stack key that is an array or a string, else those found in the text."""
    found = F.lit(None).cast("array<string>")
    for key in reversed(STACK_KEYS):
        v = F.try_variant_get(fields, f"$['{key}']", "variant")
        head = F.substring(F.to_json(v), 1, 1)
        listed = F.transform(
            F.try_variant_get(v, "$", "array<variant>"),
            lambda x: F.when(F.to_json(x).startswith('"'), F.try_variant_get(x, "$", "string")).otherwise(
                F.coalesce(F.to_json(x), F.lit("null"))
            ),
        )
        split = F.filter(F.split(F.try_variant_get(v, "$", "string"), r"\r?\n"), lambda s: s != "")
        found = F.when(head == "[", listed).when(head == '"', split).otherwise(found)
    text = F.concat(msg, F.lit("\n"), raw)
    return F.coalesce(found, F.regexp_extract_all(text, F.lit(ecma(_IN_TEXT)), F.lit(0)))


def extract_stack(events: DataFrame) -> DataFrame:
    """(id, idx, frame): one row per frame, ``idx`` from 0."""
    frames = stack_lines(F.col("fields"), F.col("msg"), F.col("raw"))
    return events.select("id", F.posexplode(frames).alias("idx", "frame"))


def parse_frames(frames: DataFrame) -> DataFrame:
    """Split ``frame`` into fn, file, line and col."""
    text = F.regexp_replace(F.regexp_replace("frame", ecma(r"^\s*at\s+"), ""), ecma(r"^\s+|\s+$"), "")
    cut = frames.withColumn("_t", text)
    t, call, place = F.col("_t"), ecma(_CALL), ecma(_PLACE)
    is_call, is_place = t.rlike(call), t.rlike(place)

    def group(pattern: str, n: int) -> Column:
        value = F.regexp_extract(t, pattern, n)
        return F.when(value != "", value)

    def pick(in_call: Column, in_place: Column, other: Column) -> Column:
        return F.when(is_call, in_call).when(is_place, in_place).otherwise(other)

    none = F.lit(None).cast("string")
    return cut.withColumns(
        {
            "fn": pick(group(call, 1), none, t),
            "file": pick(group(call, 2), group(place, 1), none),
            "line": pick(group(call, 3), group(place, 2), none).cast("bigint"),
            "col": pick(group(call, 4), group(place, 3), none).cast("bigint"),
        }
    ).drop("_t")
