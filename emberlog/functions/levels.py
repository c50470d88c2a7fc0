"""Severity levels: names, numbers, keywords and terminal colours."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("error", "warn", "info", "debug", "trace")
LEVEL_RANK = {"error": 4, "warn": 3, "info": 2, "debug": 1, "trace": 0}

# Level names of structured log lines.
LINE_LEVEL_NAMES = {
    "error": ["error", "err", "e", "fatal", "f", "panic", "crit", "critical", "alert", "emerg", "emergency"],
    "warn": ["warn", "warning", "w"],
    "info": ["info", "notice", "i"],
    "debug": ["debug", "dbg", "d"],
    "trace": ["trace", "verbose", "v"],
}
# Level names of posted batches.
POST_LEVEL_NAMES = {
    "error": ["error", "err", "fatal", "panic", "crit", "critical"],
    "warn": ["warn", "warning"],
    "info": ["info", "notice", "log"],
    "debug": ["debug", "dbg", "verbose"],
    "trace": ["trace"],
}
# Level names captured by parse rules; an unknown name changes nothing.
RULE_LEVEL_NAMES = {
    "error": ["error", "err", "e", "f", "fatal", "panic", "crit", "critical"],
    "warn": ["warn", "w", "warning"],
    "info": ["info", "i", "notice"],
    "debug": ["debug", "d", "dbg"],
    "trace": ["trace", "v"],
}
# Keywords that reveal a level inside free text, strongest class first.
LEVEL_KEYWORDS = {
    "error": r"error|err|fatal|critical|crit|panic(?:ked)?|exception|traceback|unhandled|uncaught"
    r"|emerg(?:ency)?|alert|fail(?:ed|ure)?|crash(?:ed)?|aborted",
    "warn": r"warn(?:ing)?|deprecat\w*",
    "debug": r"debug",
    "trace": r"trace|verbose",
    "info": r"info|notice",
}
# Characters that make a keyword part of a path, flag or identifier.
_OUTSIDE = r"[^A-Za-z0-9_./\\-]"


def level_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in LEVEL_RANK.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def level_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in reversed(LEVELS)]), rank.cast("int") + 1)


def _by_name(name: Column, table: dict[str, list[str]]) -> Column:
    """Level of a name through a constant map; null for an unknown name."""
    pairs = [F.lit(x) for level, names in table.items() for n in names for x in (n, level)]
    return F.try_element_at(F.create_map(*pairs), name)


def level_from_number(number: Column) -> Column:
    """Numeric levels of the Bunyan and Pino families; fractions are cut off."""
    n = F.when(F.isnan(number.cast("double")), F.lit(0)).otherwise(
        F.least(F.greatest(number.cast("double"), F.lit(-1e18)), F.lit(1e18)).cast("bigint")
    )
    return (
        F.when(n <= 15, "trace").when(n <= 25, "debug").when(n <= 35, "info").when(n <= 45, "warn").otherwise("error")
    )


def level_from_text(name: Column) -> Column:
    lc = F.lower(name)
    number = F.when(lc.rlike(r"^[+-]?\d+\z"), lc.try_cast("bigint"))
    numeric = F.when(number.isNotNull(), level_from_number(number))
    return F.coalesce(_by_name(lc, LINE_LEVEL_NAMES), numeric, F.lit("info"))


def level_from_post(name: Column) -> Column:
    """Level of a posted entry; missing and unknown names read as info."""
    return F.coalesce(_by_name(F.lower(name), POST_LEVEL_NAMES), F.lit("info"))


def level_from_rule(name: Column) -> Column:
    return _by_name(F.trim(F.lower(name)), RULE_LEVEL_NAMES)


def level_from_keywords(text: Column) -> Column:
    """Strongest keyword class found in the text, or null."""
    out = F.lit(None).cast("string")
    for level, words in reversed(LEVEL_KEYWORDS.items()):
        hit = text.rlike(rf"(?iud)(?:^|{_OUTSIDE})(?:{words})(?:{_OUTSIDE}|\z)")
        out = F.when(hit, F.lit(level)).otherwise(out)
    return out


def level_from_ansi(raw: Column) -> Column:
    """Red text means error, yellow means warn; red wins; null without either."""

    # the sequences are cut out whole and their numbers looked at as text: no match recurses per number
    found = F.regexp_extract_all(raw, F.lit(r"\x1B\[([\d;]*)m"), F.lit(1))

    def sgr(*codes: str) -> Column:
        def names(numbers: Column) -> Column:
            listed = F.concat(F.lit(";"), numbers, F.lit(";"))
            hit = reduce(or_, (F.contains(listed, F.lit(f";{c};")) for c in codes))
            return hit & ~F.contains(listed, F.lit(";;"))

        return F.contains(raw, F.lit("\x1b[")) & F.exists(found, names)

    return F.when(sgr("31", "91"), F.lit("error")).when(sgr("33", "93"), F.lit("warn"))


def strip_ansi(text: Column) -> Column:
    """Remove terminal control sequences, also one cut off at the end of the text."""
    return F.regexp_replace(text, r"(?s)\x1B(?:\[[^\x40-\x7E]*(?:[\x40-\x7E]|\z)|[^\[]|\z)", "")
