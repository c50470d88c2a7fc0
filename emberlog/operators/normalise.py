"""Raw line → structured event: the stateless stages of the normalisation chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels as L
from emberlog.functions.dialect import linear
from emberlog.functions.jsonlift import (
    LEVEL_KEYS,
    bracket_payload,
    bracket_tag,
    merge_objects,
    nested_object,
    strict_json_object,
    tag_under,
)
from emberlog.functions.rule_table import FRAME_SHAPES
from emberlog.functions.values import once, variant_at

EVENT_COLUMNS = ("id", "ts", "source", "branch", "level", "msg", "raw", "fields")


def is_stack_frame(text: Column) -> Column:
    """Whether a line has the shape of a stack frame of a known runtime."""
    return text.rlike("|".join(linear(shape) for shape in FRAME_SHAPES))


def detect_json_object(df: DataFrame, raw: str = "line") -> DataFrame:
    """Add ``is_json``: the whole line is one JSON object."""
    return df.withColumn("is_json", strict_json_object(F.col(raw)).isNotNull())


def detect_bracket_json(df: DataFrame, raw: str = "line") -> DataFrame:
    """Lines of the shape ``[tag] {json}`` with their ``tag`` and tagged ``fields``."""
    tagged = df.withColumn("tag", bracket_tag(F.col(raw))).withColumn(
        "_obj", strict_json_object(bracket_payload(F.col(raw)))
    )
    return (
        tagged.filter(F.col("_obj").isNotNull() & strict_json_object(F.col(raw)).isNull())
        .withColumn("fields", tag_under(F.col("_obj"), F.col("tag")))
        .drop("_obj")
    )


def unwrap_nested_json(df: DataFrame, column: str = "fields") -> DataFrame:
    """Lift the keys of a payload that was written as a string into its outer object."""
    inner = df.withColumn("_inner", nested_object(F.col(column)))
    lifted = F.when(F.col("_inner").isNotNull(), merge_objects(F.col(column), F.col("_inner")))
    return inner.withColumn(column, F.coalesce(lifted, F.col(column))).drop("_inner")


def parse_event(df: DataFrame, raw: str = "line") -> DataFrame:
    """Parse one line per row into ``level``, ``msg``, ``raw`` and ``fields``.

    Each stage is its own projection so that the parsed payload is computed once.
    """
    line = F.col(raw)
    opened = df.withColumn("_whole", strict_json_object(line))
    opened = opened.withColumn("_tag", F.when(F.col("_whole").isNull(), bracket_tag(line)))
    opened = opened.withColumn(
        "_obj",
        F.coalesce(
            F.col("_whole"), F.when(F.col("_tag").isNotNull(), strict_json_object(bracket_payload(line)))
        ),
    )
    opened = opened.withColumn("_inner", nested_object(F.col("_obj")))
    opened = opened.withColumn(
        "_obj",
        F.when(F.col("_inner").isNotNull(), merge_objects(F.col("_obj"), F.col("_inner"))).otherwise(F.col("_obj")),
    )
    opened = once(opened, {"_obj": tag_under(F.col("_obj"), F.col("_tag"))})

    obj = F.col("_obj")
    first_level = F.coalesce(*[variant_at(obj, k) for k in LEVEL_KEYS])
    opened = opened.withColumn("_level", first_level).withColumn("_plain", L.strip_ansi(line))
    opened = opened.withColumn("_first_msg", F.coalesce(variant_at(obj, "msg"), variant_at(obj, "message")))
    first_msg = F.col("_first_msg")
    opened = opened.withColumn(
        "_msg",
        F.when(
            obj.isNotNull(),
            F.coalesce(
                F.when(F.to_json(first_msg).startswith('"'), F.try_variant_get(first_msg, "$", "string")), F.lit("")
            ),
        ).otherwise(
            F.when(
                F.contains(F.col("_plain"), F.lit("\n")),
                F.regexp_replace(F.substring_index(F.col("_plain"), "\n", 1), r"\r+\z", ""),
            ).otherwise(F.col("_plain"))
        ),
    )
    lj = F.to_json(F.col("_level"))
    explicit = F.when(lj.startswith('"'), L.level_from_text(F.try_variant_get(F.col("_level"), "$", "string"))).when(
        lj.rlike(r"^-?\d"), L.level_from_number(lj.try_cast("double"))
    )
    opened = opened.withColumn("_explicit", explicit).withColumn(
        "_words", L.level_from_keywords(F.when(obj.isNotNull(), F.col("_msg")).otherwise(F.col("_plain")))
    )
    level = F.when(
        obj.isNotNull(),
        F.when(F.col("_explicit") != "info", F.col("_explicit")).otherwise(
            F.coalesce(F.col("_words"), F.lit("info"))
        ),
    ).otherwise(F.coalesce(F.col("_words"), L.level_from_ansi(line), F.lit("info")))
    keep = [c for c in df.columns if c not in (raw, "level", "msg", "raw", "fields")]
    done = once(opened, {"level": level, "msg": F.col("_msg")})
    return done.select(*keep, "level", "msg", line.alias("raw"), obj.alias("fields"))


def source_format_verdict(lines: DataFrame, raw: str = "line", window_lines: int = 20) -> DataFrame:
    """Per source: json or plain over its first lines; null while there are too few.

    ``row_number() <= n`` becomes a partial top-n before the shuffle, so a hot source sends only
    its first lines of every partition.
    """
    from pyspark.sql import Window

    ranked = lines.withColumn("_rn", F.row_number().over(Window.partitionBy("source").orderBy("seq")))
    first = ranked.filter(F.col("_rn") <= window_lines)
    tagged = strict_json_object(bracket_payload(F.col(raw))).isNotNull()
    ok = strict_json_object(F.col(raw)).isNotNull() | tagged
    return first.groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if(ok).alias("json_ok")
    ).withColumn(
        "verdict",
        F.when(
            F.col("seen") >= window_lines,
            F.when(F.col("json_ok") * 2 >= window_lines, F.lit("json")).otherwise(F.lit("plain")),
        ),
    )


def drop_blank_events(events: DataFrame) -> DataFrame:
    """Drop events without message, payload and raw text."""

    def blank(c: Column) -> Column:
        return ~c.rlike(r"(?U)\S")

    return events.filter(~(blank(F.col("raw")) & F.col("fields").isNull() & blank(F.col("msg"))))
