"""Find and open the JSON carried by a line: whole-line, bracket-tagged and nested payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.values import object_map, variant_at

# Keys whose string value may hold the real payload, and keys that name the level.
NESTED_KEYS = ("msg", "message", "body")
LEVEL_KEYS = ("level", "lvl", "severity", "severity_text", "levelname", "loglevel", "log_level")

_OBJECT_SHAPE = r"(?s)\A[ \t\n\r]*\{.*\}[ \t\n\r]*\z"
_TAGGED_SHAPE = r"(?sU)\A\s*\[([^\]]*)\]\s*(\{.*)\z"


def strict_json_object(text: Column) -> Column:
    """VARIANT of ``text`` when all of it is one JSON object, else null.

    ``try_parse_json`` stops at the end of the first value and ignores what follows, so the text
    must also parse inside an array (as its only element) and inside an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(
        text.rlike(_OBJECT_SHAPE) & alone & wrapped.isNotNull(),
        F.try_variant_get(listed, "$[0]", "variant"),
    )


def bracket_tag(text: Column) -> Column:
    """Tag of a ``[tag] {…}`` line; null when the line has another shape or the tag is blank."""
    tag = F.regexp_replace(F.regexp_extract(text, _TAGGED_SHAPE, 1), r"(?U)\A\s+|\s+\z", "")
    return F.when(tag != "", tag)


def bracket_payload(text: Column) -> Column:
    return F.when(bracket_tag(text).isNotNull(), F.regexp_extract(text, _TAGGED_SHAPE, 2))


def nested_object(obj: Column) -> Column:
    """The first nested payload that is itself a JSON object written as a string."""
    inner = [
        strict_json_object(
            F.when(
                F.to_json(variant_at(obj, key)).startswith('"'), F.try_variant_get(obj, f"$['{key}']", "string")
            )
        )
        for key in NESTED_KEYS
    ]
    return F.coalesce(*inner)


def merge_objects(under: Column, over: Column) -> Column:
    """Shallow merge of two VARIANT objects; ``over`` wins on equal keys."""
    return F.to_variant_object(F.map_concat(object_map(under), object_map(over)))


def unwrap_nested(obj: Column) -> Column:
    inner = nested_object(obj)
    return F.when(inner.isNotNull(), merge_objects(obj, inner)).otherwise(obj)


def tag_under(obj: Column, tag: Column) -> Column:
    """Add ``tag`` unless the object already has one."""
    base = F.create_map(F.lit("tag"), text_variant(tag))
    return F.when(tag.isNull(), obj).otherwise(F.to_variant_object(F.map_concat(base, object_map(obj))))


def text_variant(text: Column) -> Column:
    """A string as a VARIANT string."""
    return text.cast("variant")
