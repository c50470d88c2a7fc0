"""Regular-expression dialect: rewrite ECMAScript and RE2-style patterns for java.util.regex."""

from __future__ import annotations

import re

from emberlog.functions.values import JS_SPACE

_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


def _rewrite(pattern: str, space: str | None) -> str:
    """Turn ``$`` into end-of-text and, where asked, widen ``\\s``; classes are tracked."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if space and nxt == "s":
                out.append(space if in_class else f"[{space}]")
            elif space and nxt == "S" and not in_class:
                out.append(f"[^{space}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            # Java gives '[' and '&&' a meaning inside a class, the other dialects do not
            out.append("\\[" if ch == "[" else "\\&" if ch == "&" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def group_numbers(pattern: str) -> dict[str, int]:
    """Group name → number, counting every capturing group of the pattern."""
    names, number, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            named = _NAMED.match(pattern, i)
            if named:
                number += 1
                names[named.group(1)] = number
            elif pattern[i + 1 : i + 2] != "?":
                number += 1
        i += 1
    return names


def plain_groups(pattern: str) -> str:
    return _NAMED.sub("(", pattern)


# One or more words of a class, joined by a separator, before white space.
_JOINED_WORDS = re.compile(r"(\[[^\]]+\])\+\(\?:([/.:])\1\+\)\+(?=\)*\\s)")


def unrolled(pattern: str) -> str:
    """Joined words as one run of characters: the JVM's matcher recurses once per repetition of a group.

    ``[c]+(?:/[c]+)+`` before white space holds exactly the runs of class and separator that have a separator, begin
    and end with the class and have no two separators in a row.
    """

    def run(m: re.Match) -> str:
        word, by = m.group(1), m.group(2)
        both = f"[{by}{word[1:]}"
        return f"(?!{both}*{re.escape(by)}{{2}}){word}+{re.escape(by)}{both}*{word}"

    return _JOINED_WORDS.sub(run, pattern)


def ecma(pattern: str, flags: str = "") -> str:
    """Java spelling of an ECMAScript pattern (names dropped, end anchor and space class fixed)."""
    pattern = unrolled(pattern)
    marks = "".join(f for f in ("i", "s", "m") if f in flags)
    body = plain_groups(pattern) if "m" in flags else _rewrite(plain_groups(pattern), JS_SPACE)
    return f"(?{marks}{'u' if 'i' in flags else ''}){body}" if marks else body


def linear(pattern: str, flags: str = "") -> str:
    """Java spelling of an RE2-style pattern: Unicode classes, only ``\\n`` ends a line."""
    pattern = unrolled(pattern)
    marks = "dU" + "".join(f for f in ("i", "s", "m") if f in flags)
    body = plain_groups(pattern) if "m" in flags else _rewrite(plain_groups(pattern), None)
    return f"(?{marks}){body}"


def quote(text: str) -> str:
    """Match ``text`` literally."""
    return re.sub(r"([\\.\[\]{}()*+?^$|&\-#~])", r"\\\1", text)


def compiles(pattern: str) -> bool:
    """Whether the JVM accepts the pattern; an unusable pattern never matches."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        try:
            re.compile(plain_groups(pattern))
            return True
        except re.error:
            return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False
