"""Filter text → Column. A tokenizer finds the leaves; Python's own operators combine them.

``NOT``, ``AND`` and ``OR`` bind like ``~``, ``&`` and ``|``, so the token string is evaluated as
such over any algebra: boolean Columns for filtering, time bounds for scoping.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import predicates as P

_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:
      (?P<open>\() | (?P<close>\))
    | (?P<word>AND|OR|NOT)(?![A-Za-z0-9._])
    | (?P<rkey>[A-Za-z0-9._]+)~/(?P<regex>(?:\\[\s\S]|[^/\\])*)/
    | (?P<key>[A-Za-z0-9._]+):[ \t\n\r]*(?:
        (?P<op>>=|<=|>|<)?(?P<fn>percentile|last)\((?P<arg>[^)]*)\)?
      | (?P<cmp>>=|<=|>|<)(?:"(?P<cmpq>(?:\\["\\]|[^"])*)"?|(?P<cmpv>[^\s()"][^\s()]*|))
      | "(?P<quoted>(?:\\["\\]|[^"])*)"?
      | (?P<value>[^\s()"][^\s()]*)
      )
    | "(?P<phrase>(?:\\["\\]|[^"])*)"?
    | (?P<term>[^\s()]+)
    )""",
    re.VERBOSE,
)
_BAD_REGEX = re.compile(r"[ \t\n\r]*[A-Za-z0-9._]+~/")


class FilterError(ValueError):
    """The filter text has no meaning; callers show everything instead."""


@dataclass(frozen=True)
class Leaf:
    """One condition: ``kind`` is free, exact, cmp, regex, percentile or last."""

    kind: str
    key: str = ""
    value: Any = None
    op: str = ""


@dataclass(frozen=True)
class Filter:
    """A tokenised filter: its leaves and the postfix expression that combines them."""

    leaves: tuple[Leaf, ...]
    expression: str

    def over(self, leaf_value: Callable[[Leaf], Any]) -> Any:
        values: list[Any] = []
        for token in self.expression.split():
            if token == "~":
                values.append(~values.pop())
            elif token in "&|":
                right = values.pop()
                values.append(values.pop() & right if token == "&" else values.pop() | right)
            else:
                values.append(leaf_value(self.leaves[int(token[1:])]))
        return values[0]

    @property
    def aggregates(self) -> bool:
        return any(leaf.kind in ("percentile", "last") for leaf in self.leaves)

    @property
    def keys(self) -> set[str]:
        return {leaf.key for leaf in self.leaves}


def _unescape(text: str) -> str:
    return re.sub(r'\\(["\\])', r"\1", text)


def _leaf(m: re.Match, now_ms: int, zone: str) -> Leaf:
    g = m.groupdict()
    if g["rkey"] is not None:
        return Leaf("regex", g["rkey"], g["regex"])
    if g["phrase"] is not None:
        return Leaf("free", value=_unescape(g["phrase"]))
    if g["term"] is not None:
        return Leaf("free", value=g["term"])
    key = g["key"]
    if g["fn"] == "percentile":
        percent = P.parse_moment(g["arg"], now_ms) if ":" not in g["arg"] else None
        percent = 0.0 if not g["arg"].strip() else percent
        if percent is None or not 0 <= percent <= 100:
            raise FilterError(f"percentile expects 0..100, got {g['arg']!r}")
        return Leaf("percentile", key, percent, g["op"] or ">=")
    if g["fn"] == "last":
        span = P.parse_duration_ms(g["arg"])
        if span is None:
            raise FilterError(f"last expects `N unit`, got {g['arg']!r}")
        return Leaf("last", key, span, g["op"] or ">=")
    if g["cmp"]:
        text = _unescape(g["cmpq"]) if g["cmpq"] is not None else g["cmpv"]
        number = P.parse_moment(text, now_ms, zone)
        if number is None:
            raise FilterError(f"expected number or datetime, got {text!r}")
        return Leaf("cmp", key, number, g["cmp"])
    if g["quoted"] is not None:
        if g["quoted"] == "":
            return Leaf("free", value=f"{key}:")
        return Leaf("exact", key, _unescape(g["quoted"]))
    return Leaf("exact", key, g["value"])


def read_filter(text: str, now_ms: int | None = None, zone: str = "UTC") -> Filter:
    """Tokenise a filter; adjacent conditions are joined by AND. Raises :class:`FilterError`."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    body = text.rstrip(" \t\n\r")
    leaves: list[Leaf] = []
    out: list[str] = []
    at = 0
    if not body.strip():
        return Filter((Leaf("free", value=""),), "p0")
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m or (m.group("term") and _BAD_REGEX.match(body, at)):
            raise FilterError(f"cannot read {body[at:]!r}")
        at = m.end()
        word = m.group("word")
        if m.group("close"):
            if out and out[-1] == "(":
                raise FilterError("empty group")
            out.append(")")
            continue
        if word in ("AND", "OR"):
            out.append("&" if word == "AND" else "|")
            continue
        if out and (out[-1] == ")" or out[-1].startswith("p")):
            out.append("&")
        if word == "NOT":
            out.append("~")
        elif m.group("open"):
            out.append("(")
        else:
            out.append(f"p{len(leaves)}")
            leaves.append(_leaf(m, now_ms, zone))
    return Filter(tuple(leaves), " ".join(_postfix(out, text)))


_BINDS = {"~": 3, "&": 2, "|": 1}


def _postfix(tokens: list[str], text: str) -> list[str]:
    """Operators behind their operands; nesting costs list entries only. Raises where the tokens make no condition."""
    out: list[str] = []
    waiting: list[str] = []
    complete = False  # whether an operand ends here
    for token in tokens:
        if (token in "&|)") != complete:
            raise FilterError(f"cannot read {text!r}")
        if token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise FilterError(f"cannot read {text!r}")
            waiting.pop()
        elif token in "&|":
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        elif token in "~(":
            waiting.append(token)
        else:
            out.append(token)
        complete = token == ")" or token.startswith("p")
    if not complete or "(" in waiting:
        raise FilterError(f"cannot read {text!r}")
    return out + waiting[::-1]


def filter_column(
    found: Filter,
    now_ms: int,
    thresholds: dict[tuple[str, float], float] | None = None,
    pinned: Column | None = None,
    relevant: Column | None = None,
) -> Column:
    """The boolean Column of a filter whose percentile thresholds are known."""
    flags = {"pinned": pinned, "relevant": relevant}

    def leaf(c: Leaf) -> Column:
        if c.kind == "free":
            return P.match_free(c.value)
        if c.kind == "exact":
            return P.match_exact(c.key, c.value, **flags)
        if c.kind == "regex":
            return P.match_regex(c.key, c.value, **flags)
        if c.kind == "cmp":
            return P.match_compare(c.key, c.op, c.value, **flags)
        if c.kind == "last":
            return P.match_compare(c.key, c.op, now_ms - c.value, **flags)
        return P.match_compare(c.key, c.op, (thresholds or {})[c.key, c.value], **flags)

    return found.over(leaf)


def thresholds_of(df: DataFrame, *filters: Filter) -> dict[tuple[str, float], float]:
    """All percentile thresholds the filters need, each computed once."""
    wanted = {(c.key, c.value) for f in filters for c in f.leaves if c.kind == "percentile"}
    return P.percentile_thresholds(df, sorted(wanted)) if wanted else {}


def with_flags(df: DataFrame, keys: set[str], pins: DataFrame | None, relevant: DataFrame | None) -> DataFrame:
    """Add ``_pinned`` and ``_relevant`` by joining the id sets the filter really uses."""
    for key, ids, name in (("pinned", pins, "_pinned"), ("relevant", relevant, "_relevant")):
        if key in keys and ids is not None:
            mark = ids.select(F.col("id").cast("bigint")).distinct().withColumn(name, F.lit(True))
            df = df.join(mark, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        else:
            df = df.withColumn(name, F.lit(False))
    return df


def search(
    df: DataFrame,
    text: str,
    pins: DataFrame | None = None,
    relevant: DataFrame | None = None,
    now_ms: int | None = None,
    zone: str = "UTC",
    over: DataFrame | None = None,
) -> DataFrame:
    """Events that match the filter text. A text without meaning filters nothing.

    Percentiles are taken over ``over`` (default ``df``). Id sets join only when the text names them.
    """
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    try:
        found = read_filter(text, now_ms, zone)
    except FilterError:
        return df
    limits = thresholds_of(over if over is not None else df, found)
    if not found.keys & {"pinned", "relevant"}:
        return df.filter(filter_column(found, now_ms, limits))
    flagged = with_flags(df, found.keys, pins, relevant)
    return flagged.filter(
        filter_column(found, now_ms, limits, F.col("_pinned"), F.col("_relevant"))
    ).select(*df.columns)


class _Bounds:
    """Time bounds combined like conditions; ``deep`` also looks inside OR and NOT."""

    def __init__(self, lo: float | None, hi: float | None, deep: bool):
        self.lo, self.hi, self.deep = lo, hi, deep

    def _meet(self, other: _Bounds) -> _Bounds:
        lows = [b for b in (self.lo, other.lo) if b is not None]
        highs = [b for b in (self.hi, other.hi) if b is not None]
        return _Bounds(max(lows) if lows else None, min(highs) if highs else None, self.deep)

    __and__ = _meet

    def __or__(self, other: _Bounds) -> _Bounds:
        return self._meet(other) if self.deep else _Bounds(None, None, False)

    def __invert__(self) -> _Bounds:
        return self if self.deep else _Bounds(None, None, False)


def _bounds(text: str, deep: bool, strict_shift: int, now_ms: int | None, zone: str) -> tuple[float | None, float | None]:
    try:
        found = read_filter(text, now_ms, zone)
    except FilterError:
        return None, None

    def leaf(c: Leaf) -> _Bounds:
        if c.kind != "cmp" or c.key != "ts":
            return _Bounds(None, None, deep)
        if c.op in (">", ">="):
            return _Bounds(c.value + (strict_shift if c.op == ">" else 0), None, deep)
        return _Bounds(None, c.value - (strict_shift if c.op == "<" else 0), deep)

    found_bounds = found.over(leaf)
    return found_bounds.lo, found_bounds.hi


def time_range_bounds(text: str, now_ms: int | None = None, zone: str = "UTC") -> tuple[float | None, float | None]:
    """Time range a filter speaks of, through AND, OR and NOT; None for an open end."""
    return _bounds(text, True, 0, now_ms, zone)


def scope_bounds(text: str, now_ms: int | None = None, zone: str = "UTC") -> tuple[float | None, float | None]:
    """Time range every match must lie in: top-level AND conditions on ``ts`` only."""
    return _bounds(text, False, 1, now_ms, zone)
