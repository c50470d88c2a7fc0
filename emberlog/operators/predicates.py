"""Filter leaves as boolean Columns. Every leaf is true or false, never null."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.dialect import compiles, ecma, quote
from emberlog.functions.values import NUMBER_COLUMNS, lookup_path
from emberlog.operators.percentiles import exact_percentiles
from emberlog.session import stage_table

# Month names and duration units of the filter language.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNIT_MS = {
    "ms": 1,
    "s": 1_000, "sec": 1_000, "secs": 1_000, "second": 1_000, "seconds": 1_000,
    "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hr": 3_600_000, "hrs": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
    "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
    "w": 604_800_000, "week": 604_800_000, "weeks": 604_800_000,
}


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def match_free(term: str) -> Column:
    """Bare term: case-insensitive substring of the message."""
    return F.lit(True) if not term else _sure(F.contains(F.lower("msg"), F.lit(term.lower())))


def match_text(key: str, term: str) -> Column:
    """``msg:term`` and ``raw:term``: case-insensitive substring."""
    return _sure(F.contains(F.lower(F.col(key)), F.lit(term.lower())))


def match_glob(key: str, glob: str, **flags) -> Column:
    """Anchored, case-insensitive ``*`` pattern on the text form; missing reads as empty."""
    pattern = "(?iu)^" + "[^\\n\\r\u2028\u2029]*".join(quote(p) for p in glob.split("*")) + r"\z"
    return _sure(lookup_path(key, **flags).text_or_empty().rlike(pattern))


def match_exact(key: str, value: str, **flags) -> Column:
    """``key:value``: text form equals the literal; ``*`` makes it a glob, msg and raw search inside."""
    if "*" in value:
        return match_glob(key, value, **flags)
    if key in ("msg", "raw"):
        return match_text(key, value)
    return _sure(lookup_path(key, **flags).text() == value)


def match_compare(key: str, op: str, number: float, **flags) -> Column:
    """``key:>N`` and the like on the number form; a value that is no number never matches."""
    if number != number:
        return F.lit(False)
    if key in NUMBER_COLUMNS:
        # the bare column against a whole literal can be pushed into the scan
        left = F.col(NUMBER_COLUMNS[key])
        right = F.lit(int(number)) if float(number).is_integer() and abs(number) < 2**62 else F.lit(float(number))
    else:
        # Spark orders NaN above every number, so it must not reach > and >=
        left = F.nanvl(lookup_path(key, **flags).number(), F.lit(None).cast("double"))
        right = F.lit(float(number))
    result = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return result if key in NUMBER_COLUMNS else _sure(result)


def match_regex(key: str, pattern: str, **flags) -> Column:
    """``key~/re/``: case-sensitive search in the text form; an invalid pattern matches nothing."""
    java = ecma(pattern)
    if not compiles(java):
        return F.lit(False)
    return _sure(lookup_path(key, **flags).text_or_empty().rlike(java))


def match_pinned(pinned: Column, wanted: bool = True) -> Column:
    return _sure(pinned.cast("string") == str(wanted).lower())


def match_relevant(relevant: Column, wanted: bool = True) -> Column:
    return _sure(relevant.cast("string") == str(wanted).lower())


def match_has_stack(wanted: bool = True) -> Column:
    return match_exact("stack", str(wanted).lower())


def parse_duration_ms(text: str) -> int | None:
    """``15 min`` → milliseconds; None when it is no duration."""
    m = re.fullmatch(r"([\d.]+)\s*([A-Za-z]+)", text.strip(), re.ASCII)
    if not m or m.group(2).lower() not in UNIT_MS:
        return None
    try:
        return int(float(m.group(1)) * UNIT_MS[m.group(2).lower()] + 0.5)
    except ValueError:
        return None


def parse_moment(text: str, now_ms: int, zone: str = "UTC") -> float | None:
    """Comparison literal → number: a number, a clock time of today, ``Mon D``, or an ISO date-time."""
    t = text.strip()
    if not t:
        return None
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?Infinity", t, re.ASCII):
        return float(t)
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    tz = ZoneInfo(zone)
    ref = datetime.fromtimestamp(now_ms / 1000, tz)
    clock = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?", t, re.ASCII)
    if clock:
        h, mi, s, frac = clock.groups()
        day = ref.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
        span = timedelta(hours=int(h), minutes=int(mi), seconds=int(s or 0), milliseconds=int((frac or "0").ljust(3, "0")))
        return _ms((day + span).replace(tzinfo=tz))
    dated = re.fullmatch(r"([A-Za-z]{3})\s+(\d{1,2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", t, re.ASCII)
    if dated:
        name, day, h, mi, s = dated.groups()
        if name.lower() not in MONTHS:
            return None

        def in_year(year: int) -> float:
            start = datetime(year, MONTHS.index(name.lower()) + 1, 1)
            span = timedelta(days=int(day) - 1, hours=int(h or 0), minutes=int(mi or 0), seconds=int(s or 0))
            return _ms((start + span).replace(tzinfo=tz))

        this_year = in_year(ref.year)
        return this_year if this_year <= now_ms else in_year(ref.year - 1)
    try:
        iso = datetime.fromisoformat(t.replace("Z", "+00:00") if t.endswith("Z") else t)
    except ValueError:
        return None
    if iso.tzinfo is None:
        # a bare date is UTC, a zone-less date-time is local
        iso = iso.replace(tzinfo=timezone.utc if re.fullmatch(r"\d{4}-\d{2}-\d{2}", t) else tz)
    return _ms(iso)


def _ms(moment: datetime) -> float:
    return float(round(moment.timestamp() * 1000))


def match_time(key: str, op: str, text: str, now_ms: int, zone: str = "UTC") -> Column:
    """Comparison with a time literal, resolved on the driver so that ``ts`` stays prunable."""
    value = parse_moment(text, now_ms, zone)
    if value is None:
        raise ValueError(f"expected number or datetime, got {text!r}")
    return match_compare(key, op, value)


def match_last(key: str, duration: str, now_ms: int, op: str = ">=") -> Column:
    """``key:last(15 min)``: newer than that long before ``now_ms``."""
    span = parse_duration_ms(duration)
    if span is None:
        raise ValueError(f"last expects `N unit`, got {duration!r}")
    return match_compare(key, op, now_ms - span)


def number_of(key: str) -> Column:
    """Number form of a key; null where it has none."""
    return F.nanvl(lookup_path(key).number(), F.lit(None).cast("double"))


def percentile_values(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(key, v): the numbers of the keys, in one pass over the events."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), number_of(k).alias("v")) for k in keys)))
    return df.select(pairs.alias("_p")).select("_p.key", "_p.v").filter("v is not null")


def percentile_thresholds(df: DataFrame, wanted: Iterable[tuple[str, float]]) -> dict[tuple[str, float], float]:
    """Thresholds of (key, percent) pairs over all events; 0 for a key without numbers.

    The numbers of all keys are written once, so that further passes read neither texts nor payloads.
    """
    wanted = sorted(set(wanted))
    for _, p in wanted:
        if not 0 <= p <= 100:
            raise ValueError(f"percentile expects 0..100, got {p}")
    if not wanted:
        return {}
    keys = sorted({key for key, _ in wanted})
    values = stage_table(percentile_values(df, keys))
    percents = sorted({p for _, p in wanted})
    if len(keys) == 1:
        found = {(keys[0], r["p"]): r["value"] for r in exact_percentiles(values.select("v"), [], percents).collect()}
    else:
        found = {(r["key"], r["p"]): r["value"] for r in exact_percentiles(values, ["key"], percents).collect()}
    return {(key, p): found.get((key, float(p)), 0.0) for key, p in wanted}


def match_percentile(df: DataFrame, key: str, percent: float, op: str = ">=") -> Column:
    """``key:>=percentile(P)``: compare with the P-th percentile of the key over ``df``."""
    return match_compare(key, op, percentile_thresholds(df, [(key, percent)])[key, percent])


def any_of(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out


def all_of(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def facet_select(selections: dict[str, list[str]]) -> Column:
    """Chosen facet values: any value within a key, all keys together."""
    return all_of(any_of(match_exact(k, v) for v in values) for k, values in selections.items() if values)


def range_select(ranges: dict[str, list[tuple[float | None, float | None]]]) -> Column:
    """Chosen number ranges ``[lo, hi)``, either end open: any range within a key, all keys together."""

    def one(key: str, lo: float | None, hi: float | None) -> Column:
        sides = []
        if lo is not None:
            sides.append(match_compare(key, ">=", lo))
        if hi is not None:
            sides.append(match_compare(key, "<", hi))
        return all_of(sides)

    return all_of(any_of(one(k, lo, hi) for lo, hi in spans) for k, spans in ranges.items() if spans)


def percentile_select(df: DataFrame, choices: dict[str, list[float]]) -> Column:
    """Chosen ``>= percentile`` thresholds: any within a key, all keys together."""
    limits = percentile_thresholds(df, [(k, p) for k, ps in choices.items() for p in ps])
    return all_of(
        any_of(match_compare(k, ">=", limits[k, p]) for p in sorted(set(ps))) for k, ps in choices.items() if ps
    )


def exclude(key: str, value: str = "*") -> Column:
    """Everything but ``key:value``; without a value, but ``key:*``."""
    return ~match_exact(key, value)
