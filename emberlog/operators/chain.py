"""Sequential grouping with bounded look-ahead, run in parallel over chunks.

Some line grouping is a chain: starting fresh at line *i*, the rules consume a bounded number of
lines and start fresh again at line *j*. Which lines are starts depends on all earlier ones, yet
a chunk of lines is fully described by a small table: for each entry offset (below the bound) the
offset at which the chain enters the next chunk. The tables are built in parallel, composed along
each source in a tree of blocks of chunks, and a second parallel pass then walks every chunk from its entry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ordering import chunk_of, with_source_position
from emberlog.session import stage_table

CHUNK_LINES = 50_000
#: Tables composed in one step.
FAN_IN = 64


def _through(tables: list, bound: int) -> np.ndarray:
    """The table of a block of chunks: where the chain leaves it, for each entry offset below ``bound``."""
    at = np.arange(bound, dtype=np.int64)
    for table in tables:
        at = np.full(1, table[0]) if len(table) == 1 else np.asarray(table, dtype=np.int64)[at]
    return at[:1] if (at == at[0]).all() else at


def _entries(tables: DataFrame, keys: list[str], key_schema: str, bound: int, most: int) -> DataFrame:
    """Entry offset of every chunk but the first of its key, from ``tables`` (keys, chunk, exits), at most ``most`` a key.

    Upwards, every ``FAN_IN`` neighbouring tables become one; downwards, the entry of a block gives those of
    its parts. So no task sees more than that many tables, however many a key has.
    """
    levels = [tables]
    size = most
    while size > FAN_IN:
        below = levels[-1]

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            head = rows.iloc[0]
            merged = _through(rows["exits"].tolist(), bound).tolist()
            return pd.DataFrame([{**{k: head[k] for k in keys}, "chunk": head["chunk"] // FAN_IN, "exits": merged}])

        block = F.floor(F.col("chunk") / FAN_IN).alias("_block")
        levels.append(
            stage_table(below.groupBy(*keys, block).applyInPandas(merge, f"{key_schema}, chunk bigint, exits array<bigint>"))
        )
        size = -(-size // FAN_IN)

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        entry, out = int(rows["entry"].iloc[0]), []
        for chunk, table in zip(rows["chunk"], rows["exits"]):
            out.append((chunk, entry))
            entry = int(table[0] if len(table) == 1 else table[entry])
        head = rows.iloc[0]
        found = pd.DataFrame([*out, (out[-1][0] + 1, entry)], columns=["chunk", "entry"])
        return found.assign(**{k: head[k] for k in keys})[[*keys, "chunk", "entry"]]

    entries = None
    for tables in reversed(levels):
        block = F.floor(F.col("chunk") / FAN_IN)
        if entries is None:
            held = tables.withColumn("_block", block).withColumn("entry", F.lit(0).cast("bigint"))
        else:
            held = tables.withColumn("_block", block).join(entries.withColumnRenamed("chunk", "_block"), [*keys, "_block"])
        parts = held.repartition(*keys, "_block").groupBy(*keys, "_block")
        # the chunk after a block's last is the first of the next block, which has its entry from above
        found = parts.applyInPandas(part, f"{key_schema}, chunk bigint, entry bigint")
        entries = found.groupBy(*keys, "chunk").agg(F.max("entry").alias("entry"))
    return entries


def run_chain(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    next_start: Callable[[pd.DataFrame], np.ndarray],
    bound: int,
    chunk_lines: int = CHUNK_LINES,
    emit: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame] | None = None,
    emit_schema: str | None = None,
) -> DataFrame:
    """Add ``pos`` (rank inside the key) and ``start`` (``pos`` of the chain start of the row).

    ``next_start(rows)`` gives, for every row index taken as a fresh start, the index of the next
    fresh start, at most ``bound`` rows on. ``df`` should hold only what that function and the
    caller need. With ``emit`` the result is instead what it makes of the rows and the (start, end)
    row ranges of each chunk: a range lies wholly in the rows of one task.
    """
    if chunk_lines < bound:
        raise ValueError("a chunk must be at least as long as the look-ahead")
    placed = with_source_position(df, keys, order, "pos")
    chunk = chunk_of(F.col("pos"), chunk_lines)
    # the first rows of a chunk are also the look-ahead of the chunk before it
    early = (F.col("pos") % chunk_lines < bound) & (F.col("pos") >= chunk_lines)
    shared = placed.withColumn(
        "chunk", F.explode(F.when(early, F.array(chunk, chunk - 1)).otherwise(F.array(chunk)))
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def hops(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
        own = int((rows["pos"] // chunk_lines == rows["chunk"]).sum())
        return rows, next_start(rows), own

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        rows, nxt, own = hops(rows)
        exits = np.empty(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            exits[i] = nxt[i] - own if nxt[i] >= own else exits[nxt[i]]
        table = exits[: min(bound, own)]
        if len(table) and (table == table[0]).all():
            table = table[:1]
        return pd.DataFrame([{**{k: head[k] for k in keys}, "chunk": head["chunk"], "exits": table.tolist()}])

    longest = placed.agg(F.max("pos_last")).first()[0] or 0
    if longest < chunk_lines:
        shared = shared.withColumn("entry", F.lit(0).cast("bigint"))
    else:
        # dealt out by chunk here, as a table that lies by source already would not be dealt again
        shared = shared.repartition(*keys, "chunk")
        tables = (
            shared.filter(F.col("chunk") < chunk_of(F.col("pos_last"), chunk_lines))
            .groupBy(*keys, "chunk")
            .applyInPandas(summarise, f"{key_schema}, chunk bigint, exits array<bigint>")
        )
        entries = _entries(stage_table(tables), keys, key_schema, bound, longest // chunk_lines)
        shared = shared.join(entries, [*keys, "chunk"], "left").withColumn(
            "entry", F.coalesce("entry", F.lit(0).cast("bigint"))
        )
    kept = [*df.columns, "pos"]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["entry"].iloc[0])
        rows, nxt, own = hops(rows)
        if emit is not None:
            ranges = []
            while i < own:
                ranges.append((i, int(nxt[i])))
                i = int(nxt[i])
            return emit(rows, ranges)
        start = np.full(len(rows), -1, dtype=np.int64)
        pos = rows["pos"].to_numpy()
        while i < own:
            start[i : nxt[i]] = pos[i]
            i = int(nxt[i])
        out = rows[kept].assign(start=start)
        return out[out["start"] >= 0]

    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*kept).schema)
    return shared.groupBy(*keys, "chunk").applyInPandas(walk, emit_schema or f"{out_schema}, start bigint")
