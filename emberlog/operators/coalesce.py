"""Fold continuation lines (stack frames, indented blocks, error runs) into their head event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import level_of_rank, level_rank
from emberlog.functions.rule_table import BUILTIN_RULES
from emberlog.operators.carry import running_max
from emberlog.operators.chain import CHUNK_LINES, run_chain
from emberlog.operators.multiline import with_gap
from emberlog.operators.normalise import is_stack_frame
from emberlog.operators.rules import extract_body
from emberlog.session import stage_table

# Pause that ends a group, and the size caps of a group.
IDLE_MS = 150
MAX_LINES = 200
MAX_BYTES = 64 * 1024

BEFORE_ALL = -(2**63) + 1


def continues_by_shape(df: DataFrame, rules=BUILTIN_RULES) -> DataFrame:
    """Add ``cont``: frame-shaped message, or a body (prefix removed) that is indented or a frame."""
    body = df.withColumn("_body", extract_body(F.col("msg"), rules))
    return body.withColumn(
        "cont",
        is_stack_frame(F.col("msg")) | F.col("_body").rlike(r"\A[ \t]") | is_stack_frame(F.col("_body")),
    ).drop("_body")


def group_heads(df: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add ``head``: one value for the lines of a group, that is the ``seq`` of its head or ``BEFORE_ALL``, size caps left aside.

    Needs ``cont``, ``gap`` and ``err``. A line that neither continues by shape nor is an error
    always starts a group, as does one after a pause; between two such certain heads (a block) an
    error line continues only an error group. So a block splits at most once: at its first
    non-continuation error line, unless an earlier line of the block was an error already.
    """
    starter = F.col("gap") | ~F.col("cont")
    certain = F.col("gap") | (~F.col("cont") & ~F.col("err"))
    marked = df.withColumn("_starter", starter).withColumn("_certain", F.when(certain, F.col("seq")))
    blocks = running_max(marked, "source", "seq", "_certain", "_block", chunk_lines)
    # lines before the first certain head are one block; its name only has to differ from every seq
    blocks = blocks.withColumn("_block", F.coalesce("_block", F.lit(BEFORE_ALL)))
    facts = blocks.groupBy("source", "_block").agg(
        F.min(F.when(F.col("_starter") & (F.col("seq") != F.col("_block")), F.col("seq"))).alias("_turn"),
        F.min(F.when(F.col("err"), F.col("seq"))).alias("_err"),
    )
    splits = (F.col("_err") == F.col("_turn")) & (F.col("seq") >= F.col("_turn"))
    return (
        blocks.join(facts, ["source", "_block"])
        .withColumn("head", F.when(splits, F.col("_turn")).otherwise(F.col("_block")))
        .drop("_starter", "_certain", "_block", "_turn", "_err")
    )


def _refold(max_lines: int, max_bytes: int):
    """Group ends inside an over-long group, each line taken as a fresh head."""

    def next_start(rows: pd.DataFrame) -> np.ndarray:
        cont, rank, size = (rows[c].to_numpy() for c in ("cont", "rank", "bytes"))
        n = len(rows)
        nxt = np.empty(n, dtype=np.int64)
        for i in range(n):
            top, total, j = rank[i], size[i], i + 1
            while j < n and (cont[j] or (rank[j] == 4 and top == 4)):
                total += 1 + size[j]
                if total > max_bytes or j - i + 1 > max_lines:
                    break
                top = max(top, rank[j])
                j += 1
            nxt[i] = j
        return nxt

    return next_start


def coalesce_events(
    events: DataFrame,
    idle_ms: int | None = IDLE_MS,
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    rules=BUILTIN_RULES,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Group parsed lines per source in ``seq`` order; ``lines`` counts the lines of a group.

    Head message and fields are kept, raw texts are joined, the strongest level wins. Groups within
    the caps come from windows and aggregates alone; only the lines of groups over a cap take the
    sequential way, which is exact because such a group restarts the rules at its own head.
    """
    marked = continues_by_shape(events, rules)
    marked = marked.withColumn("rank", level_rank(F.col("level"))).withColumn("bytes", F.octet_length("raw"))
    staged = stage_table(marked)
    times = [c for c in ("arrival_ms", "last_arrival_ms") if c in staged.columns]
    slim = staged.select("source", "seq", *times, "cont", "rank", "bytes").withColumn("err", F.col("rank") == 4)
    heads = stage_table(
        group_heads(with_gap(slim, idle_ms, chunk_lines), chunk_lines).select(
            "source", "seq", "head", "cont", "rank", "bytes"
        )
    )
    over = (
        heads.groupBy("source", "head")
        .agg(F.count("*").alias("_lines"), (F.sum("bytes") + F.count("*") - 1).alias("_bytes"))
        .filter((F.col("_lines") > max_lines) | (F.col("_bytes") > max_bytes))
        .select("source", "head")
    )
    placed = heads.select("source", "seq", "head", F.lit(0).cast("bigint").alias("_sub"))
    if not over.isEmpty():
        beyond = heads.join(over, ["source", "head"], "left_semi")
        refolded = run_chain(
            beyond, ["source", "head"], ["seq"], _refold(max_lines, max_bytes), max_lines, max(chunk_lines, max_lines)
        )
        placed = placed.join(over, ["source", "head"], "left_anti").unionByName(
            refolded.select("source", "seq", "head", F.col("start").alias("_sub"))
        )
    lines = staged.join(placed, ["source", "seq"])
    head_values = [c for c in events.columns if c not in ("source", "seq", "level", "raw", "last_arrival_ms")]
    folded = lines.groupBy("source", "head", "_sub").agg(
        F.min("seq").alias("seq"),
        *[F.min_by(c, "seq").alias(c) for c in head_values],
        F.max("rank").alias("_rank"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda p: p["raw"]), "\n"
        ).alias("raw"),
        F.count("*").alias("lines"),
    )
    columns = [c for c in events.columns if c != "last_arrival_ms"]
    return folded.withColumn("level", level_of_rank(F.col("_rank"))).select(*columns, "lines")
