"""Numbered folders and small notes in the shared folder, read and written through Hadoop's file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """Numbers of the entries ``<prefix><number>`` of a folder, ascending; none where there is no folder."""
    files, where = _files(spark, folder)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def write_note(spark: SparkSession, path: str, note) -> None:
    """Write a small JSON value; it appears whole or not at all."""
    files, where = _files(spark, path)
    _, draft = _files(spark, f"{path}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(note).encode()))
    stream.close()
    files.delete(where, True)
    files.rename(draft, where)


def read_note(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
