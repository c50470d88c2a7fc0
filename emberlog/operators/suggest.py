"""Suggestions while typing: keys, key:value pairs and messages that contain a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import LEVELS
from emberlog.session import stage_table

# Columns offered as keys, cut-offs and shares of the merged list.
COLUMN_KEYS = ("msg", "raw", "ts", "level", "source", "branch")
TYPED_KEYS = ("msg", "raw", "ts", "pinned", "stack", "hasStackTrace")
KEY_SHARE, MESSAGE_SHARE, DEFAULT_LIMIT, COMPLETIONS = 3, 3, 8, 8


def _grams(lower: Column) -> Column:
    n = F.char_length(lower)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(lower, i, F.lit(3)))
    return F.when(n < 3, F.array(F.concat(F.lit("short:"), lower))).otherwise(F.array_distinct(cut))


def distinct_messages(events: DataFrame) -> DataFrame:
    """Distinct non-empty messages with the number of events that carry them."""
    return events.filter(F.col("msg") != "").groupBy("msg").agg(F.count("*").alias("refs"))


def message_grams(msg: Column) -> Column:
    """Distinct grams of three characters of a message, lower-cased; one of its own for a shorter message."""
    return _grams(F.lower(msg))


def trigram_index(events: DataFrame) -> DataFrame:
    """Inverted index (gram, msg, refs) over the distinct messages, lower-cased."""
    return distinct_messages(events).select(F.explode(message_grams(F.col("msg"))).alias("gram"), "msg", "refs")


def search_messages(index: DataFrame, text: str) -> DataFrame:
    """Messages (msg, refs) of a trigram index that contain the text.

    The index is filtered to the grams of the text, a message must have all of them, and a last
    check confirms the substring. Short texts scan the distinct messages.
    """
    q = text.lower()
    if not q:
        return index.select("msg", "refs").limit(0)
    hit = F.contains(F.lower("msg"), F.lit(q))
    if len(q) < 3:
        return index.filter(hit).select("msg", "refs").distinct()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    return (
        index.filter(F.col("gram").isin(*grams))
        .groupBy("msg")
        .agg(F.count("*").alias("_k"), F.first("refs").alias("refs"))
        .filter((F.col("_k") == len(grams)) & hit)
        .select("msg", "refs")
    )


def _locale(c: Column) -> Column:
    return F.collate(c, "UNICODE")


def suggest_keys(counts: DataFrame, text: str) -> DataFrame:
    """(key, score) of the columns and paths of a ``value_counts`` table that contain the text."""
    spark = counts.sparkSession
    names = counts.select(F.col("path").alias("key")).distinct()
    fixed = spark.createDataFrame([(k,) for k in COLUMN_KEYS], "key string")
    at = F.instr(F.lower("key"), F.lit(text.lower()))
    return (
        names.unionByName(fixed)
        .distinct()
        .withColumn("_at", at)
        .filter("_at > 0")
        .withColumn(
            "score",
            F.when(F.col("_at") == 1, 20.0)
            .when(F.substring(F.lower("key"), F.col("_at") - 1, F.lit(1)) == ".", 10.0)
            .otherwise(5.0),
        )
        .drop("_at")
    )


def suggest_values(counts: DataFrame, text: str) -> DataFrame:
    """(key, value, score): the two best values of every path."""
    at = F.instr(F.lower("value"), F.lit(text.lower()))
    hits = (
        counts.withColumn("_at", at)
        .filter("_at > 0")
        .select(
            F.col("path").alias("key"), "value",
            (F.log1p("count") + 3 + F.when(F.col("_at") == 1, 10).otherwise(0)).alias("score"),
        )
    )
    best = Window.partitionBy("key").orderBy(F.desc("score"), _locale(F.col("value")))
    return hits.withColumn("_rn", F.row_number().over(best)).filter("_rn <= 2").drop("_rn")


def suggest_messages(index: DataFrame, text: str) -> DataFrame:
    """(msg, score) of all messages that contain the text."""
    starts = F.startswith(F.lower("msg"), F.lit(text.lower()))
    return search_messages(index, text).select(
        "msg", (F.log1p("refs") + F.when(starts, 6.0).otherwise(2.0)).alias("score")
    )


def complete_keys(groups: DataFrame, text: str, with_relevance: bool = False) -> DataFrame:
    """(rank, key): the first eight keys that start with the typed text, fixed keys first."""
    fixed = [*TYPED_KEYS, *(["relevant"] if with_relevance else [])]
    spark = groups.sparkSession
    first = spark.createDataFrame([(i, k) for i, k in enumerate(fixed)], "ord bigint, key string")
    later = groups.select((F.col("group_rank") + 1000).alias("ord"), "key").distinct()
    hits = first.unionByName(later).filter(F.startswith(F.lower("key"), F.lit(text.lower())))
    top = hits.orderBy("ord", "key").limit(COMPLETIONS)
    # at most eight rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy("ord", "key")).cast("bigint")).select("rank", "key")


def complete_values(groups: DataFrame, key: str, text: str) -> DataFrame:
    """(rank, value): the first eight values of ``key`` that start with the typed text."""
    spark = groups.sparkSession

    def listed(names) -> DataFrame:
        return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord bigint, value string")

    if key in ("pinned", "stack", "hasStackTrace", "relevant"):
        values = listed(("true", "false"))
    else:
        values = groups.filter(F.col("key") == key).select(F.col("value_rank").alias("ord"), "value")
        if key == "level" and values.isEmpty():
            values = listed(LEVELS)
    hits = values.filter(F.startswith(F.lower("value"), F.lit(text.lower())))
    top = hits.orderBy("ord", "value").limit(COMPLETIONS)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("ord", "value")).cast("bigint")).select("rank", "value")


def suggest(counts: DataFrame, index: DataFrame, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(rank, kind, key, value, msg, score): keys, then pairs, then messages, cut at ``limit``."""
    spark = counts.sparkSession
    schema = "rank bigint, kind string, key string, value string, msg string, score double"
    if len(text) < 2:
        return spark.createDataFrame([], schema)
    counts = stage_table(counts)  # read by keys, values and the cut-off per path
    none = F.lit(None).cast("string")
    keys = suggest_keys(counts, text).orderBy(F.desc("score"), _locale(F.col("key"))).limit(KEY_SHARE)
    keys = keys.select(F.lit("key").alias("kind"), "key", none.alias("value"), none.alias("msg"), "score",
                       F.col("key").alias("_tie"), F.lit(0).alias("_group"))
    pair = F.concat("key", F.lit(":"), "value")
    pairs = suggest_values(counts, text).orderBy(F.desc("score"), _locale(pair)).limit(limit)
    pairs = pairs.select(F.lit("kv").alias("kind"), "key", "value", none.alias("msg"), "score",
                         pair.alias("_tie"), F.lit(1).alias("_group"))
    msgs = suggest_messages(index, text).orderBy(F.desc("score"), _locale(F.col("msg"))).limit(MESSAGE_SHARE)
    msgs = msgs.select(F.lit("msg").alias("kind"), none.alias("key"), none.alias("value"), "msg", "score",
                       F.col("msg").alias("_tie"), F.lit(2).alias("_group"))
    # a few rows from here on
    every = keys.unionByName(pairs).unionByName(msgs)
    in_group = Window.partitionBy("_group").orderBy(F.desc("score"), _locale(F.col("_tie")))
    ranked = every.withColumn("_rn", F.row_number().over(in_group)).withColumn(
        "_keys", F.count_if(F.col("_group") == 0).over(Window.partitionBy())
    )
    room = F.greatest(F.lit(2), F.lit(limit) - F.col("_keys") - 3)
    ranked = ranked.filter((F.col("_group") != 1) | (F.col("_rn") <= room))
    order = F.row_number().over(Window.orderBy("_group", "_rn")).cast("bigint")
    return ranked.withColumn("rank", order).filter(F.col("rank") <= limit).select(
        "rank", "kind", "key", "value", "msg", "score"
    )
