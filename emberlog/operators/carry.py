"""Per-source scans (previous value, running maximum) cut into chunks of bounded length.

A window over a whole source would put a hot source into one task. Here the window runs inside
chunks of the source's sequence numbers; one summary row per chunk carries the state across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.ordering import chunk_of


def _carried(summary: DataFrame, key: str, value: str, running: bool) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.max(value).over(w) if running else F.last(value, ignorenulls=True).over(w)
    return summary.select(key, "_chunk", carried.alias("_carry"))


def previous_value(df: DataFrame, key: str, order: str, value: str, name: str, chunk_lines: int) -> DataFrame:
    """Add ``name``: ``value`` of the row before, in ``order``, among the rows of ``key``."""
    cut = df.withColumn("_chunk", chunk_of(F.col(order), chunk_lines))
    inside = cut.withColumn("_prev", F.lag(value).over(Window.partitionBy(key, "_chunk").orderBy(order)))
    summary = cut.groupBy(key, "_chunk").agg(F.max_by(value, order).alias("_last"))
    return (
        inside.join(_carried(summary, key, "_last", False), [key, "_chunk"])
        .withColumn(name, F.coalesce("_prev", "_carry"))
        .drop("_prev", "_carry", "_chunk")
    )


def running_max(df: DataFrame, key: str, order: str, value: str, name: str, chunk_lines: int) -> DataFrame:
    """Add ``name``: maximum of ``value`` over this and all earlier rows of ``key``."""
    cut = df.withColumn("_chunk", chunk_of(F.col(order), chunk_lines))
    w = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("_run", F.max(value).over(w))
    summary = cut.groupBy(key, "_chunk").agg(F.max(value).alias("_last"))
    return (
        inside.join(_carried(summary, key, "_last", True), [key, "_chunk"])
        .withColumn(name, F.greatest("_run", "_carry"))
        .drop("_run", "_carry", "_chunk")
    )
