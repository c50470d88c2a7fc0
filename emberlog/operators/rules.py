"""Parse rules: unwrap the prefixes other tools put around a message."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.dialect import compiles, ecma, group_numbers, linear
from emberlog.functions.jsonlift import text_variant
from emberlog.functions.levels import level_from_rule
from emberlog.functions.rule_table import BUILTIN_RULES
from emberlog.functions.values import object_map, once

_SLOT = re.compile(r"\$\{(\w+)\}")


def _in_order(rules: Iterable[dict]) -> list[dict]:
    return sorted(rules, key=lambda r: r["order"])


def _captures(text: Column, pattern: str, numbers: list[int]) -> Column:
    """Array of the wanted groups of the first match, null without a match."""
    wanted = F.array(*[F.lit(n) for n in numbers]).cast("array<int>")
    return F.when(text.rlike(pattern), F.transform(wanted, lambda n: F.call_function("regexp_extract", text, F.lit(pattern), n)))


def _template(template: str, names: list[str]) -> Column:
    """Fill ``${name}`` slots from the captures; an unknown or unset group is empty."""
    parts, last = [], 0
    for slot in _SLOT.finditer(template):
        if slot.start() > last:
            parts.append(F.lit(template[last : slot.start()]))
        name = slot.group(1)
        parts.append(F.get("_caps", F.lit(names.index(name))) if name in names else F.lit(""))
        last = slot.end()
    if last < len(template):
        parts.append(F.lit(template[last:]))
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def extract_body(text: Column, rules: Iterable[dict] = BUILTIN_RULES) -> Column:
    """Body captured by the first matching rule that has a ``body`` group, else the text."""
    out = text
    for rule in reversed(_in_order(rules)):
        groups = group_numbers(rule["pattern"])
        pattern = linear(rule["pattern"], rule.get("flags") or "")
        if "body" in groups and compiles(pattern):
            out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, groups["body"])).otherwise(out)
    return out


def _strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value; null when it is not valid JSON."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(alone & wrapped.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def apply_parse_rules(events: DataFrame, rules: Iterable[dict] = BUILTIN_RULES) -> DataFrame:
    """Run every rule, in order, on the running message and fill source, level, msg and fields.

    One projection per rule: a later rule sees the message an earlier one left behind. Templates
    that read like JSON are stored parsed; ``merge_fields`` spreads a JSON object over the fields.
    A rule whose pattern does not compile is skipped.
    """
    columns = events.columns
    df = events.withColumn("_map", object_map(F.col("fields"))).withColumn("_any", F.lit(False))
    for rule in _in_order(rules):
        groups = group_numbers(rule["pattern"])
        pattern = ecma(rule["pattern"], rule.get("flags") or "")
        if not compiles(pattern):
            continue
        out = rule["output"]
        templates = [out.get(k) or "" for k in ("source", "msg", "level", "merge_fields")]
        templates += list((out.get("fields") or {}).values())
        names = [n for n in groups if any("${" + n + "}" in t for t in templates)]
        hit = F.col("_caps").isNotNull()
        df = df.withColumn("_caps", _captures(F.col("msg"), pattern, [groups[n] for n in names]))

        def fill(template: str, names: list[str] = names) -> Column:
            return _template(template, names)

        changed: dict[str, Column] = {"_any": F.col("_any") | hit}
        for name in ("source", "msg"):
            if out.get(name) is not None:
                value = fill(out[name])
                changed[name] = F.when(hit & (value != ""), value).otherwise(F.col(name))
        if out.get("level") is not None:
            changed["level"] = F.when(hit, F.coalesce(level_from_rule(fill(out["level"])), F.col("level"))).otherwise(
                F.col("level")
            )
        if out.get("fields") or out.get("merge_fields"):
            empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
            merged = F.coalesce(F.col("_map"), empty)
            if out.get("fields"):
                entries = []
                for key, template in out["fields"].items():
                    text = fill(template)
                    parsed = F.when(text.rlike(r"\A\s*[\[{]"), _strict_json(text))
                    entries += [F.lit(key), F.coalesce(parsed, text_variant(text))]
                merged = F.map_concat(merged, F.create_map(*entries))
            if out.get("merge_fields"):
                spread = object_map(_strict_json(fill(out["merge_fields"])))
                merged = F.when(spread.isNotNull(), F.map_concat(merged, spread)).otherwise(merged)
            changed["_map"] = F.when(hit, merged).otherwise(F.col("_map"))
        df = df.withColumns(changed)
    mirrored = F.map_concat(
        F.col("_map"),
        F.create_map(
            F.lit("source"), text_variant(F.col("source")),
            F.lit("level"), text_variant(F.col("level")),
            F.lit("msg"), text_variant(F.col("msg")),
        ),
    )
    fields = F.when(
        F.col("_any") & F.col("_map").isNotNull(), F.to_variant_object(mirrored)
    ).otherwise(F.col("fields"))
    done = once(df, {"fields": fields, **{c: F.col(c) for c in ("source", "level", "msg")}})
    return done.select(*columns)
