"""Field lookup and the two loose conversions (text, number) used by every filter.

A filter compares the *text form* or the *number form* of a dynamic value. Both follow
ECMAScript ``String(x)`` and ``Number(x)``; a missing value reads ``undefined`` and NaN.
Everything here is a JVM-side Column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that ECMAScript trims, as a Java character class body.
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_RARE_NUMBER = r"^(0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
# Text of a VARIANT that needs a second look: arrays, objects, and numbers not spelled as ECMAScript does.
_SPECIAL_TEXT = (
    r"^(?:[\[{]|-?(?!(?:0|[1-9]\d{0,14})$)(?!(?:0\.0{0,5}[1-9]|[1-9]\d{0,8}\.\d{0,5}[1-9])$)\d[\d.E+-]*$)"
)


def _let(value: Column, body) -> Column:
    """Evaluate ``body`` on ``value`` bound once, however often the body uses it.

    Keeps the rarely taken branches out of the generated code of the common ones.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def _number_in_base(text: Column, base: Column) -> Column:
    """Value of the digits behind a two-character prefix, as a double, whatever their number."""
    digits = F.split(text.substr(F.lit(3), F.char_length(text)), "")
    value = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0.0), lambda acc, d: acc * base + value(d))


def _number_of_odd_text(text: Column) -> Column:
    def read(t: Column) -> Column:
        base = F.when(F.lower(F.substring(t, 2, 1)) == "x", 16).when(F.lower(F.substring(t, 2, 1)) == "o", 8).otherwise(2)
        return (
            F.when(t.rlike(_PLAIN_NUMBER), t.try_cast("double"))
            .when(t == "", F.lit(0.0))
            .when(t.rlike(_RARE_NUMBER), _number_in_base(F.lower(t), base))
            .when(t.rlike(r"^[+-]?Infinity$"), F.when(t.startswith("-"), float("-inf")).otherwise(float("inf")))
            .otherwise(F.lit(float("nan")))
        )

    return _let(js_trim(text), read)


def number_of_text(text: Column) -> Column:
    """Number form of a string; NaN when it does not read as one."""
    return (
        F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double"))
        .when(text.isNull(), F.lit(float("nan")))
        .otherwise(_number_of_odd_text(text))
    )


def _strip_zeros(text: Column) -> Column:
    cut = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(cut == "-0", F.lit("0")).otherwise(cut)


def text_of_number(text: Column) -> Column:
    """ECMAScript text of a JSON number given its JSON spelling."""
    d = text.try_cast("double")
    java = d.cast("string")
    size = F.abs(d)
    plain = F.when(size >= 1, java.try_cast("decimal(38,16)").cast("string")).otherwise(
        java.try_cast("decimal(38,24)").cast("string")
    )
    power = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-"
    )
    return (
        F.when(text.rlike(r"^-?[1-9]\d{0,14}$"), text)
        .when(text.rlike(r"^-?(0|[1-9]\d{0,8})\.\d{1,6}$"), _strip_zeros(text))
        .when(d == 0, F.lit("0"))
        .when((size >= 1e-6) & (size < 1e21), _strip_zeros(plain))
        .otherwise(power)
    )


def _scalar_text(v: Column, json: Column) -> Column:
    head = F.substring(json, 1, 1)
    return (
        F.when(head == '"', F.try_variant_get(v, "$", "string"))
        .when(head.isin("t", "f", "n"), json)
        .when(head == "{", F.lit("[object Object]"))
        .otherwise(text_of_number(json))
    )


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _element_text(v: Column) -> Column:
    """Text of an array element that is no array; null counts as empty."""
    json = F.to_json(v)
    return F.when(v.isNull() | (json == "null"), F.lit("")).otherwise(_scalar_text(v, json))


def _joined(v: Column) -> Column:
    """Comma-joined text of an array; inner arrays are joined in place, an empty one is an empty text.

    A fold opens one level of arrays per step. The number of opening brackets in the JSON text bounds the depth, so
    none is cut off.
    """
    json = F.to_json(v)
    levels = F.char_length(json) - F.char_length(F.replace(json, F.lit("["), F.lit(""))) - 1
    nothing = F.array(F.lit(None).cast("variant"))

    def opened(items: Column, _: Column) -> Column:
        def inner(x: Column) -> Column:
            held = _items(x)
            return F.when(held.isNull(), F.array(x)).when(F.size(held) == 0, nothing).otherwise(held)

        return F.flatten(F.transform(items, inner))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    leaves = F.aggregate(steps, _items(v), opened)
    return F.array_join(F.transform(leaves, _element_text), ",")


def _full_text(v: Column) -> Column:
    json = F.to_json(v)
    return F.when(json.startswith("["), _joined(v)).otherwise(_scalar_text(v, json))


def text_of_variant(v: Column, plain: Column | None = None, missing: str = "undefined", null: str = "null") -> Column:
    """``String(v)``: ``undefined`` when missing, ``null`` for JSON null, arrays comma-joined.

    ``plain`` is the value as Spark casts it to a string, which already is the answer for strings,
    booleans and most numbers.
    """
    plain = F.try_variant_get(v, "$", "string") if plain is None else plain
    absent = F.lit(missing) if missing == null else F.when(v.isNull(), F.lit(missing)).otherwise(F.lit(null))
    return (
        F.when(plain.isNull(), absent).when(plain.rlike(_SPECIAL_TEXT), _let(v, _full_text)).otherwise(plain)
    )


def _odd_number(v: Column) -> Column:
    json = F.to_json(v)
    head = F.substring(json, 1, 1)
    # an array reads as its only element, whatever the nesting
    inner = F.regexp_replace(F.regexp_replace(json, r'^\[+"?|"?\]+$', ""), r"^null$", "")
    text = (
        F.when(head == '"', F.try_variant_get(v, "$", "string"))
        .when(head == "[", inner)
        .when(head == "n", F.lit(""))
        .when(head == "t", F.lit("1"))
        .when(head == "f", F.lit("0"))
        .otherwise(json)
    )
    return _number_of_odd_text(text)


def number_of_variant(v: Column, plain: Column | None = None) -> Column:
    """``Number(v)``: NaN when missing, 0 for JSON null, booleans 1 and 0."""
    plain = F.try_variant_get(v, "$", "string") if plain is None else plain
    return (
        F.when(plain.rlike(_PLAIN_NUMBER), plain.try_cast("double"))
        .when(v.isNull(), F.lit(float("nan")))
        .otherwise(_let(v, _odd_number))
    )


def strict_number_of_variant(v: Column) -> Column:
    """Numbers and numeric strings only; null for every other kind of value."""
    plain = F.try_variant_get(v, "$", "string")

    def odd(x: Column) -> Column:
        text = F.when(F.to_json(x).startswith('"'), F.try_variant_get(x, "$", "string"))
        return F.when(text.isNotNull(), F.nanvl(_number_of_odd_text(text), F.lit(None).cast("double")))

    return F.when(plain.rlike(_PLAIN_NUMBER), plain.try_cast("double")).when(plain.isNotNull(), _let(v, odd))


def object_map(v: Column) -> Column:
    """A VARIANT object as ``map<string,variant>``; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _quoted(segment: str) -> str:
    return "['" + segment.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _is_index(segment: str) -> bool:
    return segment.isascii() and segment.isdigit() and str(int(segment)) == segment and int(segment) < 2**31


def _walk(root: Column, path: str, kind: str) -> Column:
    cur, run = root, ""
    segments = path.split(".")
    for i, segment in enumerate(segments):
        if not _is_index(segment) and segment != "length":
            run += _quoted(segment)
            continue
        if run:
            cur, run = F.try_variant_get(cur, "$" + run, "variant"), ""
        keyed = F.try_variant_get(cur, "$" + _quoted(segment), "variant")
        if segment == "length":
            items = F.try_variant_get(cur, "$", "array<variant>")
            cur = F.when(items.isNotNull(), F.parse_json(F.size(items).cast("string"))).otherwise(keyed)
        else:
            cur = F.coalesce(keyed, F.try_variant_get(cur, f"$[{segment}]", "variant"))
    if run or kind != "variant":
        cur = F.try_variant_get(cur, "$" + run, kind)
    return cur


def variant_at(root: Column, path: str) -> Column:
    """Walk a dotted path; a numeric segment also indexes arrays, ``length`` also sizes them."""
    return _walk(root, path, "variant")


def string_at(root: Column, path: str) -> Column:
    """The value at a path as Spark casts it to a string, in one step from the payload."""
    return _walk(root, path, "string")


# Keys that name a column of the event and shadow the payload.
TEXT_COLUMNS = ("level", "source", "branch", "msg", "raw")
NUMBER_COLUMNS = {"ts": "ts", "timestamp": "ts", "id": "id"}
STACK_KEYS = ("stack", "stacktrace", "stack_trace", "trace")


def has_stack(fields: Column) -> Column:
    """True when a stack key holds a non-empty array or a non-blank string."""
    checks = []
    for key in STACK_KEYS:
        v = F.try_variant_get(fields, "$" + _quoted(key), "variant")
        json = F.to_json(v)
        text = F.try_variant_get(v, "$", "string")
        checks.append(json.startswith("[") & (json != "[]"))
        checks.append(json.startswith('"') & (js_trim(text) != ""))
    found = checks[0]
    for c in checks[1:]:
        found = F.coalesce(found, F.lit(False)) | F.coalesce(c, F.lit(False))
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Value:
    """One looked-up value: its Column, which of text, number, flag or variant it is, and its cast."""

    kind: str
    col: Column
    plain: Column | None = None

    def text(self) -> Column:
        if self.kind == "variant":
            return text_of_variant(self.col, self.plain)
        return F.coalesce(self.col.cast("string"), F.lit("undefined"))

    def text_or_empty(self) -> Column:
        """Text form with missing and null reading as the empty string."""
        if self.kind == "variant":
            return text_of_variant(self.col, self.plain, "", "")
        return F.coalesce(self.col.cast("string"), F.lit(""))

    def number(self) -> Column:
        if self.kind == "variant":
            return number_of_variant(self.col, self.plain)
        if self.kind == "text":
            return number_of_text(self.col)
        return self.col.cast("int" if self.kind == "flag" else "double").cast("double")


def lookup_path(key: str, pinned: Column | None = None, relevant: Column | None = None) -> Value:
    """Resolve a filter key: event columns first, then the session flags, then the payload."""
    if key in TEXT_COLUMNS:
        return Value("text", F.col(key))
    if key in NUMBER_COLUMNS:
        return Value("number", F.col(NUMBER_COLUMNS[key]))
    if key in ("stack", "hasStackTrace"):
        return Value("flag", has_stack(F.col("fields")))
    if key == "pinned":
        return Value("flag", pinned if pinned is not None else F.lit(False))
    if key == "relevant":
        return Value("flag", relevant if relevant is not None else F.lit(False))
    return Value("variant", variant_at(F.col("fields"), key), string_at(F.col("fields"), key))


def once(df, columns: dict[str, Column]):
    """Add or replace columns that later steps read as results, not as expressions.

    A filter on an ordinary computed column is pushed below it with the expression copied in, which
    for long expressions costs far more than it saves. A generated column stays where it is.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)
