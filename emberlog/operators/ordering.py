"""Dense positions in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage_table

_ROW_BITS = 33  # monotonically_increasing_id(): partition number above, row number below
_STRETCH_BITS = 12  # rows of the global order that share a row of their key's bounds


def with_dense_position(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based rank of each row in the order of the ``order`` columns.

    One range shuffle sorts the rows, which are written once with their place; the row counts per
    partition (one small row each) turn the row number inside a partition into a global rank.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = F.monotonically_increasing_id()
    placed = stage_table(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", mark)
    )
    part = F.shiftright("_m", _ROW_BITS)
    counts = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for row in counts:
        starts.append((row["p"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    row_number = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_start") + row_number)
        .drop("_m", "_part", "_start")
    )


def with_source_position(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0-based rank of each row among the rows of its ``keys``; a hot key is split.

    Also adds ``<name>_last``, the last rank of the key. Rows of a key lie next to each other in the global order, so they
    learn where it begins from a table of a row per key and stretch of that order, and no join goes by the key alone.
    """
    global_pos = f"_{name}_g"
    ranked = with_dense_position(df, [*keys, *order], global_pos)
    ranked = ranked.withColumn("_stretch", F.shiftright(global_pos, _STRETCH_BITS))
    stretches = ranked.groupBy(*keys, "_stretch").agg(F.min(global_pos).alias("_lo"), F.max(global_pos).alias("_hi"))
    spans = stretches.groupBy(*keys).agg(F.min("_lo").alias("_lo"), (F.max("_hi") - F.min("_lo")).alias(f"{name}_last"))
    bounds = stretches.drop("_lo", "_hi").join(spans, keys)
    return (
        ranked.join(bounds, [*keys, "_stretch"])
        .withColumn(name, F.col(global_pos) - F.col("_lo"))
        .drop("_lo", "_stretch", global_pos)
    )


def assign_event_ids(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dense ids from 1 in arrival order across all sources."""
    order = order or ["arrival_ms", "source", "seq"]
    return with_dense_position(events, order, "id").withColumn("id", F.col("id") + 1)


def chunk_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")
