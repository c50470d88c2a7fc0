"""Time histogram with aligned, gap-free buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket sizes in ms, wanted and least number of buckets.
BUCKET_SIZES = (1, 10, 100, 1_000, 10_000, 60_000, 300_000, 3_600_000, 86_400_000)
TARGET_BUCKETS, LEAST_BUCKETS = 60, 24


def pick_bucket(range_ms: Column) -> Column:
    """Smallest size that needs at most sixty buckets, else one day."""
    out = F.lit(BUCKET_SIZES[-1])
    for size in reversed(BUCKET_SIZES):
        out = F.when(range_ms / size <= TARGET_BUCKETS, F.lit(size)).otherwise(out)
    return out.cast("bigint")


def bucket_size(range_ms: int) -> int:
    return next((s for s in BUCKET_SIZES if range_ms / s <= TARGET_BUCKETS), BUCKET_SIZES[-1])


def bucket_counts(events: DataFrame, start: Column, size: Column) -> DataFrame:
    level = F.col("level")
    return events.groupBy((F.floor((F.col("ts") - start) / size) * size + start).cast("bigint").alias("ts")).agg(
        F.count_if(level == "error").alias("err"),
        F.count_if(level == "warn").alias("warn"),
        F.count_if(~level.isin("error", "warn")).alias("rest"),
        F.count("*").alias("total"),
    )


def histogram(events: DataFrame) -> DataFrame:
    """Error, warning and other counts per bucket, empty buckets included, at least 24 buckets.

    One scan for the time range, one for the counts, which combine before the shuffle.
    """
    spark = events.sparkSession
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        none = spark.range(0).select(F.col("id").alias("ts"))
        return none.select("ts", *[F.lit(0).cast("bigint").alias(c) for c in ("err", "warn", "rest", "total")])
    hi = lo + 1 if hi == lo else hi
    size = bucket_size(hi - lo)
    start = lo // size * size
    count = max(1, round((math.ceil((hi + 1) / size) * size - start) / size))
    if count < LEAST_BUCKETS:
        start -= (LEAST_BUCKETS - count) // 2 * size
        count = LEAST_BUCKETS
    grid = spark.range(count).select((F.col("id") * size + start).alias("ts"))
    filled = grid.join(bucket_counts(events, F.lit(start), F.lit(size)), "ts", "left")
    return filled.select("ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("err", "warn", "rest", "total")])
