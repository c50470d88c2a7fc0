"""Line sources: text files, tables of lines, and batched JSON posts."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.levels import level_from_post
from emberlog.operators.ordering import with_dense_position

# Longest source name accepted in a posted batch, in bytes.
MAX_SOURCE_BYTES = 256

#: Lines of a micro-batch are numbered below the batch's number.
BATCH_BITS = 40


def drop_blank_lines(lines: DataFrame) -> DataFrame:
    """Blank lines are dropped before anything else looks at them."""
    return lines.filter(F.col("line").rlike(r"(?U)\S"))


def _source_of_file(path: str, pattern: str | None) -> Column:
    """Source of a line: what ``pattern`` captures of the file's path, or the path below the input, extension off.

    Equal file names in two folders are two sources that way. A single input file is named by its own name.
    """
    file = F.col("_metadata.file_path")
    if pattern is not None:
        return F.regexp_extract(file, pattern, 1)
    folder = path.split("://")[-1]
    folder = re.split(r"[*?\[{]", folder)[0]
    folder = (folder if folder != path.split("://")[-1] else folder + "/").rpartition("/")[0]
    at = F.instr(file, F.lit(folder + "/"))
    below = F.when(at > 0, file.substr(at + len(folder) + 1, F.char_length(file)))
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    return F.regexp_replace(F.coalesce(below, name), r"\.[^./]*$", "")


def read_lines(
    spark: SparkSession, path: str, branch: str = "", stream: bool = False, source_pattern: str | None = None
) -> DataFrame:
    """Lines of text files: the file's path below ``path`` is the source, ``seq`` keeps the order inside a file.

    Whole files stay splittable: ``seq`` comes from the split's start offset and the row in it. A stream brings the marks of that order
    instead, from which ``in_live_order`` numbers the lines of each micro-batch.
    """
    reader = spark.readStream if stream else spark.read
    text = reader.format("text").load(path)
    named = text.select(
        _source_of_file(path, source_pattern).alias("source"),
        F.lit(branch).alias("branch"),
        *([
            F.col("_metadata.file_modification_time").alias("_file_time"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        ] if stream else [
            # 2^33 rows fit below the partition number; offsets order the splits of one file
            (F.col("_metadata.file_block_start") * F.lit(1 << 20)
             + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("seq")
        ]),
        F.col("value").alias("line"),
    )
    return drop_blank_lines(named)


def in_live_order(lines: DataFrame, number: int) -> DataFrame:
    """Lines of a micro-batch of ``read_lines`` with ``seq``: by batch, then file time, file, and place in the file.

    So a source whose log is continued in a later file goes on where it was.
    """
    marked = lines.withColumn("_row", F.monotonically_increasing_id())
    ordered = with_dense_position(marked, ["_file_time", "_file", "_block", "_row"], "seq")
    return ordered.withColumn("seq", F.col("seq") + F.lit(number << BATCH_BITS)).drop("_file_time", "_file", "_block", "_row")


def lines_of_table(table: DataFrame) -> DataFrame:
    """Any table with source, branch, seq and line."""
    return drop_blank_lines(table)


def explode_envelopes(posts: DataFrame, body: str = "body", now_ms: int | None = None) -> DataFrame:
    """Batched posts (JSON text) → events. A post with an empty or over-long source is rejected whole."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    schema = "source string, branch string, events array<struct<ts bigint, level string, text string, meta variant>>"
    keep = [c for c in posts.columns if c != body]
    opened = posts.select(*keep, F.from_json(body, schema).alias("_b"))
    valid = opened.filter(F.octet_length("_b.source").between(1, MAX_SOURCE_BYTES))
    rows = valid.select(
        *keep, F.col("_b.source").alias("source"), F.coalesce("_b.branch", F.lit("")).alias("branch"),
        F.posexplode("_b.events").alias("pos", "_e"),
    )
    raw = F.to_json(
        F.struct(F.col("_e.level").alias("level"), F.col("_e.meta").alias("meta"), F.col("_e.text").alias("text"),
                 F.col("_e.ts").alias("ts")),
        {"ignoreNullFields": "false"},
    )
    return rows.select(
        *keep, "pos", F.coalesce("_e.ts", F.lit(now_ms)).alias("ts"), "source", "branch",
        level_from_post(F.col("_e.level")).alias("level"), F.col("_e.text").alias("msg"), raw.alias("raw"),
        F.col("_e.meta").alias("fields"),
    )


def http_exchange_events(exchanges: DataFrame) -> DataFrame:
    """Request and response of each exchange as two events (``part`` 0 and 1).

    Expects source, ts, method, url, status, status_text, error; ``status`` 0 is a failed request. The message
    shortens a long URL; method, whole url and status are columns beside it.
    """

    def cut(c: str, n: int):
        return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(
            F.coalesce(c, F.lit(""))
        )

    status = F.col("status")
    answer = F.trim(
        F.concat(F.lit("← "), status.cast("string"), F.lit(" "), F.coalesce("status_text", F.lit("")), F.lit(" "),
                 cut("url", 180))
    )
    failure = F.rtrim(F.concat(F.lit("× "), cut("url", 180), F.lit(" "), F.coalesce("error", F.lit(""))))
    level = (
        F.when(status >= 500, "error").when(status >= 400, "warn").when(status == 0, "error").otherwise("info")
    )
    request = F.struct(
        F.lit(0).alias("part"), F.lit("info").alias("level"),
        F.concat(F.lit("→ "), F.upper("method"), F.lit(" "), cut("url", 200)).alias("msg"),
    )
    response = F.struct(
        F.lit(1).alias("part"), level.alias("level"), F.when(status == 0, failure).otherwise(answer).alias("msg")
    )
    keep = [c for c in exchanges.columns if c not in ("source", "status_text", "error")]
    return exchanges.select(
        *keep, F.concat("source", F.lit(":net")).alias("source"), F.explode(F.array(request, response)).alias("_e")
    ).select(*keep, "source", F.col("_e.part").cast("bigint").alias("part"), "_e.level", "_e.msg")
