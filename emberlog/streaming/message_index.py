"""A trigram index over distinct messages that takes new and evicted events without being built anew.

What is stored is additive: a batch of events adds the number of times each of its messages arrived, less the times it
was evicted, to the message and to each of its grams. Nothing stored is read for that. Runs are merged by adding
up, and what comes to nothing leaves with the merge that reaches the oldest run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.suggest import distinct_messages, message_grams, search_messages
from emberlog.streaming.upsert import GONE, KeyedTable

#: Folders that the postings of a run are spread over.
BUCKETS = 64


class CountedTable(KeyedTable):
    """A keyed table whose runs hold changes of ``refs`` that add up; ``folder`` names a column to lay runs out by."""

    def __init__(self, spark: SparkSession, out: str, keys: list[str], folder: str | None = None):
        super().__init__(spark, out, keys)
        self.folder = folder

    def _write(self, rows: DataFrame, path: str) -> None:
        if not self.folder:
            return super()._write(rows, path)
        # few files a folder, and a folder with many rows is still written by many tasks
        rows.hint("rebalance", self.folder).write.mode("overwrite").partitionBy(self.folder).parquet(path)

    def _load(self, runs: list[dict], schema: str) -> DataFrame:
        found = None
        for run in runs:
            rows = self.spark.read.schema(schema).parquet(f"{self.out}/runs/{run['name']}")
            found = rows if found is None else found.unionByName(rows)
        return found

    def _newest(self, rows: DataFrame) -> DataFrame:
        added = rows.groupBy(*self.keys).agg(F.sum("refs").alias("refs"), F.max("_version").alias("_version"))
        return added.withColumn(GONE, F.col("refs") == 0)


class MessageIndex:
    """Messages with their counts, and postings by gram in hash buckets, under ``out``.

    ``change`` puts events in and takes events out as one version; the same version may be written again after a
    failure. A search reads the buckets of its grams only; texts of one or two characters read the messages.
    """

    def __init__(self, spark: SparkSession, out: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.messages = CountedTable(spark, f"{out}/messages", ["msg"])
        self.postings = CountedTable(spark, f"{out}/postings", ["bucket", "gram", "msg"], "bucket")

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def change(self, version: int, added: DataFrame | None = None, evicted: DataFrame | None = None) -> int:
        """Put in and take out events (``msg``); evicted events must have been put in before. Returns the rows written."""
        moved = None
        for events, sign in ((added, 1), (evicted, -1)):
            if events is not None:
                part = distinct_messages(events).withColumn("refs", sign * F.col("refs"))
                moved = part if moved is None else moved.unionByName(part)
        if moved is None:
            return 0
        moved = moved.groupBy("msg").agg(F.sum("refs").alias("refs")).filter("refs <> 0").persist()
        grams = moved.select(F.explode(message_grams(F.col("msg"))).alias("gram"), "msg", "refs")
        postings = grams.select(self._bucket(F.col("gram")).alias("bucket"), "gram", "msg", "refs")
        try:
            return self.messages.upsert(moved, version) + self.postings.upsert(postings, version)
        finally:
            moved.unpersist()

    def _held(self, table: CountedTable, schema: str, version: int) -> DataFrame:
        rows = table.read(version)
        return self.spark.createDataFrame([], schema) if rows is None else rows.filter("refs > 0")

    def read(self, version: int = 2**62) -> DataFrame:
        """(gram, msg, refs), the same rows as ``trigram_index`` of the events held."""
        return self._held(self.postings, "bucket int, gram string, msg string, refs bigint", version).drop("bucket")

    def search(self, text: str, version: int = 2**62) -> DataFrame:
        """(msg, refs) of the messages that contain the text."""
        if len(text) < 3:
            return search_messages(self._held(self.messages, "msg string, refs bigint", version), text)
        low = text.lower()
        buckets = [self._bucket(F.lit(low[i : i + 3])) for i in range(len(low) - 2)]
        held = self._held(self.postings, "bucket int, gram string, msg string, refs bigint", version)
        return search_messages(held.filter(F.col("bucket").isin(*buckets)), text)
