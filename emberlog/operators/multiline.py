"""Join pretty-printed JSON that was split over several lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.chain import CHUNK_LINES, run_chain
from emberlog.session import stage_table

# A record longer than this is handed on line by line.
MAX_LINES = 500
MAX_BYTES = 256 * 1024


#: Where a line may begin or end: outside strings, inside one, or inside one behind a backslash that takes the next character.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
# possessive throughout, so that the time grows with the line and the matcher doesn't recurse
_INNER = r'(?:[^"\\]++|\\.)*+'
_STRINGS = rf'(?s)"{_INNER}(?:"|\\?\z)'
_OPEN = rf'(?s)\A(?:[^"]++|"{_INNER}")*+"{_INNER}\\?\z'


def _summary(text: Column) -> tuple[Column, Column]:
    """Change of bracket depth over a text that begins outside strings, and where it ends."""
    outside = F.regexp_replace(text, _STRINGS, "")  # an open string runs to the end of the line
    change = F.length(F.regexp_replace(outside, r"[^{\[]", "")) - F.length(F.regexp_replace(outside, r"[^}\]]", ""))
    slashes = F.length(F.regexp_extract(text, r"(?<!\\)(\\*+)\z", 1))
    end = F.when(~text.rlike(_OPEN), OUTSIDE).when(slashes % 2 == 0, INSIDE).otherwise(ESCAPED)
    return change, end


def with_summaries(lines: DataFrame) -> DataFrame:
    """Add what a line does to the brackets around it: ``does_s`` for each place ``s`` where it may begin.

    That is four times the change of depth plus the place where it ends.

    A line that begins inside a string is one that begins outside behind a quotation mark.
    """
    line = F.col("line")
    telling = line.rlike(r'[{}\[\]"\\]')  # other lines change nothing
    begun = {
        OUTSIDE: line,
        INSIDE: F.concat(F.lit('"'), line),
        ESCAPED: F.concat(F.lit('"'), F.substring(line, 2, 2**31 - 1)),
    }
    for place, text in begun.items():
        change, end = _summary(text)
        plain = F.lit(OUTSIDE if place == OUTSIDE else INSIDE)
        # one value of both, so that each pattern is run once a line
        both = F.when(telling, change * 4 + end).otherwise(plain).cast("int")
        lines = lines.withColumn(f"does_{place}", both)
    return lines


def _pauses(rows: pd.DataFrame, idle_ms: int | None) -> np.ndarray:
    """Whether the producer paused before a line. The first row's answer is never asked for."""
    pause = np.zeros(len(rows), dtype=bool)
    if idle_ms is not None and "arrival_ms" in rows:
        pause[1:] = np.diff(rows["arrival_ms"].to_numpy()) > idle_ms
    return pause


def _ends(rows: pd.DataFrame, starts: np.ndarray, max_lines: int, max_bytes: int, idle_ms: int | None):
    """Where the record begun at each of ``starts`` ends, and whether its brackets and strings are closed there.

    All records grow by one line at a time together; each line is looked up by the place where it begins.
    """
    n = len(rows)
    pause = _pauses(rows, idle_ms)
    does = np.stack([rows[f"does_{s}"].to_numpy() for s in (OUTSIDE, INSIDE, ESCAPED)])
    changes, ends = does >> 2, does & 3
    widths = rows["bytes"].to_numpy()
    stop, closed = starts + 1, np.zeros(len(starts), dtype=bool)
    going = np.arange(len(starts))
    depth, place, size = changes[OUTSIDE, starts].astype(np.int64), ends[OUTSIDE, starts], widths[starts].astype(np.int64)
    while len(going):
        line = stop[going]
        more = line < n
        more[more] = ~pause[line[more]]
        going, depth, place, size, line = (x[more] for x in (going, depth, place, size, line))
        depth, place, size = depth + changes[place, line], ends[place, line], size + 1 + widths[line]
        stop[going] = line + 1
        done = (depth <= 0) & (place == OUTSIDE)
        closed[going] = done
        on = ~done & (line + 1 - starts[going] < max_lines) & (size < max_bytes)
        going, depth, place, size = (x[on] for x in (going, depth, place, size))
    return stop, closed


def _first_lines(rows: pd.DataFrame, ranges: list[tuple[int, int]], max_lines: int, max_bytes: int, idle_ms: int | None) -> pd.DataFrame:
    """``source, seq, _first``: the record of every line that shares one; a record that hit a cap while open stays split."""
    first = np.full(len(rows), -1, dtype=np.int64)
    several = np.array([r for r in ranges if r[1] - r[0] > 1], dtype=np.int64).reshape(-1, 2)
    _, closed = _ends(rows, several[:, 0], max_lines, max_bytes, idle_ms)
    total = np.concatenate([[0], np.cumsum(rows["bytes"].to_numpy() + 1)])
    for (i, j), whole in zip(several.tolist(), closed.tolist()):
        if whole or (j - i < max_lines and total[j] - total[i] - 1 < max_bytes):
            first[i:j] = i
    kept = np.flatnonzero(first >= 0)
    seq = rows["seq"].to_numpy()
    return pd.DataFrame({"source": rows["source"].iloc[kept], "seq": seq[kept], "_first": seq[first[kept]]})


def join_multiline_json(
    lines: DataFrame,
    idle_ms: int | None = None,
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Join the lines of an open JSON record with newlines, per source and in ``seq`` order.

    Blank lines are dropped first. Sources without any opening line pass through untouched. With
    ``idle_ms`` a pause between two arrivals also closes a record. A record over a cap is emitted
    line by line.
    """
    columns = lines.columns
    kept = lines.filter(F.col("line").rlike(r"(?U)\S"))
    # only these few numbers of a line take part in the grouping; its text stays in the JVM
    timed = [c for c in ("arrival_ms",) if c in columns]
    slim = stage_table(
        with_summaries(kept.withColumn("bytes", F.octet_length("line").cast("bigint"))).withColumn(
            "opener", F.col("line").rlike(r"(?U)\A\s*[{\[]") & ((F.col("does_0") > 0) | (F.col("does_0").bitwiseAND(3) != OUTSIDE))
        ).select(
            "source", "seq", *timed, "opener", "bytes", *(f"does_{s}" for s in (OUTSIDE, INSIDE, ESCAPED))
        )
    )
    with_opener = slim.groupBy("source").agg(F.max("opener").alias("_any")).filter("_any").select("source")
    work = slim.join(with_opener, "source", "left_semi")

    def step(rows: pd.DataFrame) -> np.ndarray:
        nxt = np.arange(1, len(rows) + 1, dtype=np.int64)
        openers = np.flatnonzero(rows["opener"].to_numpy())
        nxt[openers], _ = _ends(rows, openers, max_lines, max_bytes, idle_ms)
        return nxt

    def emit(rows: pd.DataFrame, ranges: list[tuple[int, int]]) -> pd.DataFrame:
        return _first_lines(rows, ranges, max_lines, max_bytes, idle_ms)

    kinds = dict(lines.select("source", "seq").dtypes)
    members = run_chain(
        work, ["source"], ["seq"], step, max_lines, max(chunk_lines, max_lines), emit,
        f"source {kinds['source']}, seq {kinds['seq']}, _first {kinds['seq']}",
    )
    placed = stage_table(kept.select(*columns).join(members, ["source", "seq"], "left"))
    alone = placed.filter(F.col("_first").isNull()).drop("_first")
    if timed:
        alone = alone.withColumn("last_arrival_ms", F.col("arrival_ms"))
    # a group holds at most max_lines lines or the one that went beyond max_bytes
    head_values = [c for c in columns if c not in ("source", "seq", "line")]
    joined = placed.filter(F.col("_first").isNotNull()).groupBy("source", "_first").agg(
        F.min("seq").alias("seq"),
        *[F.min_by(c, "seq").alias(c) for c in head_values],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda p: p["line"]), "\n").alias("line"),
        *[F.max_by(c, "seq").alias("last_arrival_ms") for c in timed],
    )
    out = [*columns, *(["last_arrival_ms"] if timed else [])]
    return joined.select(*out).unionByName(alone.select(*out))


def with_gap(df: DataFrame, idle_ms: int | None, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add ``gap``: the producer paused before this line. False everywhere without ``idle_ms``."""
    if idle_ms is None or "arrival_ms" not in df.columns:
        return df.withColumn("gap", F.lit(False))
    from emberlog.operators.carry import previous_value

    last = "last_arrival_ms" if "last_arrival_ms" in df.columns else "arrival_ms"
    seen = previous_value(df, "source", "seq", last, "_before", chunk_lines)
    pause = F.col("arrival_ms") - F.col("_before") > idle_ms
    return seen.withColumn("gap", F.coalesce(pause, F.lit(False))).drop("_before")
