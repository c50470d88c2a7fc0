"""Exact order statistics by counting, without sorting the values or meeting them in one task.

Pass 1 counts the values in logarithmic bins; the bin that holds the wanted rank becomes a bracket
with known bounds and base rank. While a bracket still holds too many values it is cut into 65,536
linear bins. Every window below runs over the bins or distinct values of one key, whose number is
bounded, never over its raw values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import materialise_small

LINEAR_BINS = 65_536
SMALL_BRACKET = 200_000


def rank_of_percent(percent: Column, count: Column) -> Column:
    """0-based rank of a percentile: the floor rule, clamped to the last value."""
    return F.least(count - 1, F.greatest(F.lit(0), F.floor(percent / 100 * count)))


def _log_bin(v: Column) -> Column:
    """Order-preserving bin number, at most about 131,000 different ones."""
    size = F.abs(v)
    # an infinite value gets a bin of its own, so every bin has a finite width
    step = F.when(size == float("inf"), F.lit(100_000)).otherwise(F.floor(F.log2(size + 1) * 64))
    return (F.signum(v) * step).cast("int")


def _holder(counted: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of ``counted`` (bins with ``c`` values) that hold the wanted ``rank``, made relative."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("c").over(w))
    inside = (F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("c") <= F.col("rank"))
    return upto.filter(inside).withColumn("rank", F.col("rank") - (F.col("_upto") - F.col("c"))).drop("_upto")


def exact_percentiles(values: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """``keys…, p, n, value`` of the doubles in column ``v`` (nulls do not count), for each key and percent."""
    bins = values.groupBy(*keys, _log_bin(F.col("v")).alias("_bin")).agg(
        F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).filter("_bin is not null")
    total = Window.partitionBy(*keys)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    counted = bins.withColumn("n", F.sum("c").over(total)).select("*", wanted.alias("p"))
    counted = counted.withColumn("rank", rank_of_percent(F.col("p"), F.col("n")))
    columns = [*keys, "p", "n", "rank", "c", "lo", "hi"]
    brackets = materialise_small(_holder(counted, [*keys, "p"], "_bin").select(*columns))
    while True:
        open_ = brackets.filter("lo < hi")
        widest = open_.agg(F.max("c")).first()[0]
        if widest is None:
            return brackets.select(*keys, "p", "n", F.col("lo").alias("value"))
        small = widest <= SMALL_BRACKET
        if keys:
            hit = values.join(open_.drop("c"), keys).filter("v >= lo and v <= hi")
        else:  # a handful of brackets: literals instead of a join
            lits = [
                F.struct(*[F.lit(r[c]).alias(c) for c in ("p", "n", "rank", "lo", "hi")]) for r in open_.collect()
            ]
            mine = F.filter(F.array(*lits), lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
            hit = values.select("v", F.explode(mine).alias("_b")).select("v", "_b.*")
        cut = (
            F.col("v")
            if small
            else F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (LINEAR_BINS - 1))
        )
        parts = hit.groupBy(*keys, "p", "n", "rank", cut.alias("_cut")).agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        narrowed = _holder(parts, [*keys, "p"], "_cut").select(*columns)
        brackets = materialise_small(narrowed.unionByName(brackets.filter("lo = hi")))
