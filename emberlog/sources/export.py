"""Events as JSON lines and as flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsonlift import text_variant
from emberlog.functions.values import object_map
from emberlog.operators.normalise import EVENT_COLUMNS


def jsonl_rows(events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, json) of all events or of a chosen id set; a missing payload is left out."""
    picked = events if ids is None else events.join(ids.select("id"), "id", "left_semi")
    return picked.select("id", F.to_json(F.struct(*EVENT_COLUMNS)).alias("json"))


def export_jsonl(events: DataFrame, path: str, ids: DataFrame | None = None) -> None:
    """Write the JSON lines, one file per partition."""
    jsonl_rows(events, ids).select(F.col("json").alias("value")).write.mode("errorifexists").text(path)


def _base(**columns: Column) -> Column:
    return F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c)])


def _number(c: str) -> Column:
    return F.col(c).cast("variant")


def flat_record(events: DataFrame) -> DataFrame:
    """(id, record): ts, level, source and msg overlaid by the payload, which wins."""
    base = _base(ts=_number("ts"), level=text_variant(F.col("level")), source=text_variant(F.col("source")),
                 msg=text_variant(F.col("msg")))
    payload = object_map(F.col("fields"))
    merged = F.when(payload.isNotNull(), F.map_concat(base, payload)).otherwise(base)
    return events.select("id", F.to_variant_object(merged).alias("record"))


def inspect_record(events: DataFrame) -> DataFrame:
    """(id, record): the payload, or the event columns of a plain event, under a known branch."""
    plain = _base(id=_number("id"), ts=_number("ts"), source=text_variant(F.col("source")),
                  level=text_variant(F.col("level")), msg=text_variant(F.col("msg")), raw=text_variant(F.col("raw")))
    base = F.coalesce(object_map(F.col("fields")), plain)
    branch = _base(branch=text_variant(F.col("branch")))
    merged = F.when(F.col("branch") != "", F.map_concat(branch, base)).otherwise(base)
    return events.select("id", F.to_variant_object(merged).alias("record"))
