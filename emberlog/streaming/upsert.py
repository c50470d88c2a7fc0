"""A keyed table that micro-batches change: what a batch writes follows the batch, not the table.

Every batch adds one run with its changed rows. When the newest runs hold at least half as many rows as the one before
them, they are merged into one, so a row is rewritten about as often as the table doubles. A note per version names its
runs; a version that is written again after a failure starts from the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.streaming.folders import numbers, read_note, remove, write_note

#: Marks rows that take their key out of the table.
GONE = "_gone"


class KeyedTable:
    """Newest row per ``keys`` under ``out``, by version."""

    def __init__(self, spark: SparkSession, out: str, keys: list[str]):
        self.spark, self.out, self.keys = spark, out, keys

    def _versions(self, upto: int) -> list[int]:
        return [n for n in numbers(self.spark, f"{self.out}/notes") if n <= upto]

    def _note(self, upto: int) -> dict:
        found = self._versions(upto)
        return read_note(self.spark, f"{self.out}/notes/{found[-1]}") if found else {"runs": [], "schema": None}

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)

    def _load(self, runs: list[dict], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.out}/runs/{r['name']}" for r in runs))

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_version").alias("_row"))
        return best.select(*self.keys, *(F.col(f"_row.{c}").alias(c) for c in values))

    def upsert(self, rows: DataFrame, version: int) -> int:
        """Put the rows (one per key; ``_gone`` true deletes) in as ``version``; the number of rows written, merges included."""
        if GONE not in rows.columns:
            rows = rows.withColumn(GONE, F.lit(False))
        rows = rows.withColumn("_version", F.lit(version).cast("bigint"))
        before = self._note(version - 1)
        name = f"v{version}"
        self._write(rows, f"{self.out}/runs/{name}")
        # column names and types only: what a file holds may be null
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        count = self.spark.read.schema(schema).parquet(f"{self.out}/runs/{name}").count()
        runs, written = list(before["runs"]), count
        if count:
            runs.append({"name": name, "rows": count})
            first, size = len(runs) - 1, count
            while first and 2 * size >= runs[first - 1]["rows"]:
                first -= 1
                size += runs[first]["rows"]
            if first < len(runs) - 1:
                merged = self._newest(self._load(runs[first:], schema))
                if not first:  # nothing older is left to be taken out
                    merged = merged.filter(~F.col(GONE))
                self._write(merged, f"{self.out}/runs/{name}m")
                size = self.spark.read.schema(schema).parquet(f"{self.out}/runs/{name}m").count()
                runs[first:] = [{"name": f"{name}m", "rows": size}]
                written += size
        write_note(self.spark, f"{self.out}/notes/{version}", {"runs": runs, "schema": schema})
        self._forget(version, {r["name"] for r in [*runs, *before["runs"]]})
        return written

    def _forget(self, version: int, needed: set[str]) -> None:
        """Remove what neither this version nor the one before it names."""
        versions = self._versions(version - 1)
        for old in versions[:-1]:
            for run in read_note(self.spark, f"{self.out}/notes/{old}")["runs"]:
                if run["name"] not in needed:
                    remove(self.spark, f"{self.out}/runs/{run['name']}")
            remove(self.spark, f"{self.out}/notes/{old}")
        if f"v{version}" not in needed:
            remove(self.spark, f"{self.out}/runs/v{version}")

    def read(self, version: int = 2**62) -> DataFrame | None:
        """The table as of a version; None before the first row."""
        note = self._note(version)
        if not note["runs"]:
            return None
        rows = self._load(note["runs"], note["schema"])
        if len(note["runs"]) > 1:
            rows = self._newest(rows)
        return rows.filter(~F.col(GONE)).drop(GONE, "_version")
