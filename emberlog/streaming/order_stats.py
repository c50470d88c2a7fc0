"""Percentiles that keep up with a stream, exactly, without reading what came before.

Kept per key are the counts of its values in logarithmic bins, whose number is bounded, and the distinct values of the
bins that hold a wanted rank. A batch adds its own to both. Only where a rank wanders into another bin are the values
of that one bin read from what is stored, sorted by bin, of earlier batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from emberlog.operators.percentiles import _holder, _log_bin, rank_of_percent
from emberlog.operators.predicates import any_of, number_of, percentile_values
from emberlog.streaming.folders import numbers, read_note, remove, write_note
from emberlog.streaming.upsert import GONE, KeyedTable

Limits = dict[tuple[str, float], float]
COUNTED = "key string, bin int, v double, c bigint"


class LivePercentiles:
    """Thresholds of (key, percent) pairs over all events of the batches so far."""

    def __init__(self, spark: SparkSession, out: str, wanted: list[tuple[str, float]]):
        self.spark, self.out, self.wanted = spark, out, sorted(set(wanted))

    def _note(self, below: int) -> dict | None:
        found = [n for n in numbers(self.spark, f"{self.out}/notes") if n < below]
        return read_note(self.spark, f"{self.out}/notes/{found[-1]}") if found else None

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.out}/{folder}")

    def limits_before(self, number: int) -> Limits:
        note = self._note(number)
        return {(k, p): v for k, p, v, _ in note["limits"]} if note else {}

    def add(self, batch: DataFrame, number: int) -> Limits:
        """Take in the events of a batch and give the thresholds as of then; 0 for a key without numbers."""
        keys = sorted({k for k, _ in self.wanted})
        values = percentile_values(batch, keys).withColumn("bin", _log_bin(F.col("v")))
        new = values.groupBy("key", "bin", "v").agg(F.count("*").alias("c"))
        new.sortWithinPartitions("key", "bin").write.mode("overwrite").parquet(f"{self.out}/values/part={number}")
        new = self._read(f"values/part={number}", COUNTED)
        before = self._note(number)
        binned = "key string, bin int, c bigint"
        counts = new.select("key", "bin", "c")
        if before:
            counts = counts.unionByName(self._read(f"counts/v{before['number']}", binned))
        counts.groupBy("key", "bin").agg(F.sum("c").alias("c")).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/counts/v{number}")
        counts = self._read(f"counts/v{number}", binned)
        asked = self.spark.createDataFrame(self.wanted, "key string, p double")
        totals = counts.groupBy("key").agg(F.sum("c").alias("n"))
        ranked = counts.join(totals, "key").join(F.broadcast(asked), "key")  # a row per wanted percentile
        at = _holder(ranked.withColumn("rank", rank_of_percent(F.col("p"), F.col("n"))), ["key", "p"], "bin")
        places = {(r.key, r.p): (r.bin, r.rank) for r in at.select("key", "p", "bin", "rank").collect()}
        bins = {(k, b) for (k, _), (b, _) in places.items()}
        known = {(k, b) for k, _, _, b in before["limits"] if b is not None} if before else set()
        chosen = lambda some: any_of((F.col("key") == k) & (F.col("bin") == b) for k, b in sorted(some))
        held = new.filter(chosen(bins & known))
        if before:
            held = held.unionByName(self._read(f"held/v{before['number']}", COUNTED).filter(chosen(bins & known)))
        if bins - known:
            stored = self.spark.read.schema(f"{COUNTED}, part int").parquet(f"{self.out}/values").filter(F.col("part") <= number)
            held = held.unionByName(stored.filter(chosen(bins - known)).drop("part"))
        held.groupBy("key", "bin", "v").agg(F.sum("c").alias("c")).write.mode("overwrite").parquet(f"{self.out}/held/v{number}")
        held = self._read(f"held/v{number}", COUNTED)
        limits: Limits = {pair: 0.0 for pair in self.wanted}
        if places:
            ranks = self.spark.createDataFrame([(k, p, b, r) for (k, p), (b, r) in places.items()], "key string, p double, bin int, rank bigint")
            found = _holder(held.join(F.broadcast(ranks), ["key", "bin"]), ["key", "p"], "v")
            limits |= {(r.key, r.p): r.v for r in found.select("key", "p", "v").collect()}
        rows = [[k, p, v, places[k, p][0] if (k, p) in places else None] for (k, p), v in limits.items()]
        write_note(self.spark, f"{self.out}/notes/{number}", {"number": number, "limits": rows})
        for old in [n for n in numbers(self.spark, f"{self.out}/notes") if n < number][:-1]:
            for what in (f"counts/v{old}", f"held/v{old}", f"notes/{old}"):
                remove(self.spark, f"{self.out}/{what}")
        return limits


class JudgedStream:
    """Events under a judgement that depends on percentiles of all events so far.

    A batch is judged when it comes. Of the earlier events only those are judged again that have a value between a threshold's old and new
    place; the judgements are kept in a keyed table.
    """

    def __init__(self, spark: SparkSession, out: str, wanted: list[tuple[str, float]], judge: Callable[[DataFrame, Limits], DataFrame]):
        """``judge`` gives the rows to keep, with an ``id``, and ``_gone`` true on those that do not count."""
        self.spark, self.out, self.judge = spark, out, judge
        self.percentiles = LivePercentiles(spark, f"{out}/percentiles", wanted)
        self.table = KeyedTable(spark, f"{out}/judged", ["id"])

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Take in a batch; its own events that count."""
        batch.write.mode("overwrite").parquet(f"{self.out}/seen/part={number}")
        new = self.spark.read.schema(batch.schema).parquet(f"{self.out}/seen/part={number}")
        before, limits = self.percentiles.limits_before(number), self.percentiles.add(new, number)
        judged = self.judge(new, limits)
        changed = judged
        moved = [(k, *sorted((before[k, p], v))) for (k, p), v in limits.items() if (k, p) in before and before[k, p] != v]
        if moved:
            schema = StructType([*batch.schema.fields, StructField("part", IntegerType())])
            old = self.spark.read.schema(schema).parquet(f"{self.out}/seen").filter(F.col("part") < number)
            changed = changed.unionByName(self.judge(old.drop("part").filter(any_of(map(_between, moved))), limits))
        self.table.upsert(changed, number)
        return judged.filter(~F.col(GONE)).drop(GONE)


def _between(move: tuple[str, float, float]) -> Column:
    key, low, high = move
    return F.coalesce(number_of(key).between(low, high), F.lit(False))
