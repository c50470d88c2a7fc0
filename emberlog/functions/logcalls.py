"""Log calls in source text: find the call, its balanced arguments and the static text pieces."""

from __future__ import annotations

import re

# Spellings of log calls in the supported languages, and format placeholders.
LOG_CALL = re.compile(
    r"\b(?:console\.\w+|log\.\w+|logger\.\w+|tracing::\w+!|println!|eprintln!|info!|warn!|error!|debug!|trace!"
    r"|logging\.\w+|fmt\.Println|fmt\.Printf|slog\.\w+|printf|fprintf|System\.out\.print(?:ln|f)?)\s*\(",
    re.IGNORECASE,
)
PLACEHOLDER = re.compile(r"\{[^}]*\}|%[a-zA-Z]")

_LITERAL = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\])*)\1""", re.DOTALL)
_TOKEN = re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*\1|[()]|["'`]""", re.DOTALL)
_ESCAPE = re.compile(r"\\(.?)", re.DOTALL)
_NAMED_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _closing(text: str, opened: int) -> int | None:
    """Index of the parenthesis that closes the one at ``opened``; literals are skipped."""
    depth = 0
    for token in _TOKEN.finditer(text, opened):
        mark = token.group()
        if mark == "(":
            depth += 1
        elif mark == ")":
            depth -= 1
            if depth == 0:
                return token.start()
        elif len(mark) == 1:
            return None  # a literal that never ends
    return None


def _outside_templates(text: str) -> list[str]:
    """Text of a back-tick literal around its ``${…}`` expressions."""
    parts, at = [], 0
    while (start := text.find("${", at)) >= 0:
        parts.append(text[at:start])
        depth, at = 1, start + 2
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
    return [*parts, text[at:]]


def static_pieces(args: str) -> list[str]:
    """Static text of all string literals in an argument list, in order; at least two letters or digits each."""
    out = []
    for quote, inner in _LITERAL.findall(args):
        for part in _outside_templates(inner) if quote == "`" else PLACEHOLDER.split(inner):
            text = _ESCAPE.sub(lambda m: _NAMED_ESCAPES.get(m.group(1), m.group(1)), part).strip()
            if sum(ch.isalnum() for ch in text) >= 2:
                out.append(text)
    return out


def log_calls(content: str) -> list[tuple[int, str, list[str]]]:
    """(line, call text, pieces) of every log call that has static text."""
    out = []
    for call in LOG_CALL.finditer(content):
        closed = _closing(content, call.end() - 1)
        if closed is None:
            continue
        pieces = static_pieces(content[call.end() : closed])
        if pieces:
            out.append((content.count("\n", 0, call.start()) + 1, content[call.start() : closed + 1], pieces))
    return out
