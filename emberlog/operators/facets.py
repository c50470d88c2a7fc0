"""Facets over dynamic fields: value counts per path, their ranking, and numeric thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.values import (
    number_of_text,
    object_map,
    once,
    strict_number_of_variant,
    text_of_variant,
)
from emberlog.operators.percentiles import exact_percentiles
from emberlog.operators.search import scope_bounds
from emberlog.session import small_side, stage_table

# Keys mirrored by event columns, names of time fields, ranking order, sizes.
MIRRORED_KEYS = ("level", "source", "branch", "msg", "raw", "ts", "id", "timestamp")
TIME_LEAVES = (
    "ts", "timestamp", "time", "created_at", "updated_at", "started_at", "ended_at", "expires_at", "deleted_at",
)
TIME_SUFFIX = r"(?i)(^|_)(at|ts|time)\z"
UNIX_MS_KEYS = ("ts", "timestamp", "time", "created_at", "updated_at")
UNIX_MS_FLOOR, UNIX_MS_CEIL = 1_000_000_000_000, 5_000_000_000_000
NOT_TIME_SUFFIX = r"(?i)(id|count|size|bytes|len|length|port|pid|status|code)\z"
KEY_PRIORITY = (
    "method", "status_code", "status", "code", "path", "endpoint", "url", "request_id", "trace_id", "user.id", "user_id",
)
MAX_GROUPS, MAX_VALUES, TOP_GROUPS = 50, 50, 7
MIN_NUMBERS, MIN_DISTINCT, MIN_NUMERIC_SHARE = 16, 16, 0.8
NOT_NUMERIC_NAME = r"(?i)(^|\.|_)(status|status_code|code|id|pid|port)\z"
PERCENT_STOPS = (50, 75, 90, 95, 99)


def leaves_of(fields: Column) -> Column:
    """Array of (path, v) leaves of a VARIANT object; arrays and nulls are leaves.

    A fold opens one level of nested objects per step. The number of opening braces in the JSON
    text bounds the depth, so every row takes just the steps it needs and none is cut off.
    """
    entry = "struct<path:string,v:variant>"
    json = F.to_json(fields)
    steps = F.char_length(json) - F.char_length(F.replace(json, F.lit("{"), F.lit("")))
    start = F.struct(
        F.array().cast(f"array<{entry}>").alias("leaves"),
        F.array(F.struct(F.lit("").alias("path"), fields.alias("v"))).alias("open"),
    )

    def opened(pending: Column) -> Column:
        def children(p: Column) -> Column:
            prefix = F.when(p["path"] == "", F.lit("")).otherwise(F.concat(p["path"], F.lit(".")))
            return F.transform(
                F.map_entries(object_map(p["v"])),
                lambda e: F.struct(F.concat(prefix, e["key"]).alias("path"), e["value"].alias("v")),
            )

        return F.flatten(F.transform(pending, children))

    def step(acc: Column, _: Column) -> Column:
        def split(found: Column) -> Column:
            return F.struct(
                F.concat(acc["leaves"], F.filter(found, lambda x: object_map(x["v"]).isNull())).alias("leaves"),
                F.filter(found, lambda x: object_map(x["v"]).isNotNull()).alias("open"),
            )

        return F.transform(F.array(opened(acc["open"])), split)[0]

    folded = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["leaves"])
    return F.when(object_map(fields).isNotNull(), folded)


def flatten_fields(events: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per payload leaf: the kept columns, ``path`` and VARIANT ``v``.

    The top level is exploded as a map; only values that are objects themselves go through the fold.
    """
    top = events.select(*keep, F.explode(object_map(F.col("fields"))).alias("_key", "_v"))
    whole = F.array(F.struct(F.lit("").alias("path"), F.col("_v").alias("v")))
    rows = top.select(*keep, "_key", F.explode(F.coalesce(leaves_of(F.col("_v")), whole)).alias("_l"))
    path = F.when(F.col("_l.path") == "", F.col("_key")).otherwise(F.concat("_key", F.lit("."), "_l.path"))
    return rows.select(*keep, path.alias("path"), F.col("_l.v").alias("v"))


def leaf_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def is_time_name(path: Column) -> Column:
    leaf = leaf_name(path)
    return leaf.isin(*TIME_LEAVES) | leaf.rlike(TIME_SUFFIX)


def detect_unix_ms(path: Column, text: Column) -> Column:
    """The Unix-ms reading of a value whose name and size suggest a time, else null."""
    n = number_of_text(text)
    whole = (n == F.floor(n)) & n.between(UNIX_MS_FLOOR, UNIX_MS_CEIL)
    leaf = leaf_name(path)
    return F.when(whole & (leaf.isin(*UNIX_MS_KEYS) | ~leaf.rlike(NOT_TIME_SUFFIX)), n.cast("bigint"))


def is_time_dimension(path: Column, first_value: Column) -> Column:
    """A path that is a time field by name or by its first seen value."""
    return is_time_name(path) | detect_unix_ms(path, first_value).isNotNull()


def first_values(events: DataFrame) -> DataFrame:
    """(path, first_value): the JSON text each path has in its event of the smallest id.

    The ids are found first, by an aggregate that holds no texts and so needs no sort; only those events are opened again.
    """
    firsts = stage_table(flatten_fields(events).groupBy("path").agg(F.min("id").alias("id")))
    opened = events.join(small_side(firsts.select("id").distinct()), "id", "left_semi")
    values = flatten_fields(opened).join(small_side(firsts), ["path", "id"]).groupBy("path").agg(
        F.min(F.to_json("v")).alias("first_value")
    )
    return firsts.select("path").join(values, "path", "left")


def level_facet(events: DataFrame, count: Column | None = None) -> DataFrame:
    """Counts per level; ``count`` adds up rows that stand for several events."""
    return events.groupBy("level").agg((F.count("*") if count is None else count).alias("count"))


def source_facet(events: DataFrame, count: Column | None = None) -> DataFrame:
    """Counts per source; nothing when there is only one."""
    counts = events.groupBy("source").agg((F.count("*") if count is None else count).alias("count"))
    several = Window.partitionBy()  # one row per source
    return counts.withColumn("_n", F.count("*").over(several)).filter("_n > 1").drop("_n")


def branch_facet(events: DataFrame, count: Column | None = None) -> DataFrame:
    named = events.filter(F.col("branch") != "")
    return named.groupBy("branch").agg((F.count("*") if count is None else count).alias("count"))


def producer_lists(events: DataFrame) -> DataFrame:
    """Sorted names per kind, one row each, as shown in the pickers."""
    shown = None
    for kind, facet in (("source", source_facet(events)), ("branch", branch_facet(events))):
        part = facet.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"))
        shown = part if shown is None else shown.unionByName(part)
    return shown.orderBy("kind", "name")


def path_values(events: DataFrame) -> DataFrame:
    """(id, path, value, is_null) text leaves of the paths that may become facets."""
    leaves = flatten_fields(events).filter(~F.col("path").isin(*MIRRORED_KEYS) & ~is_time_name(F.col("path")))
    missing = F.is_variant_null("v")
    return leaves.select(
        "id", "path", F.when(missing, F.lit("")).otherwise(text_of_variant(F.col("v"))).alias("value"),
        missing.alias("is_null"),
    )


def value_counts(events: DataFrame) -> DataFrame:
    """(path, value, count, nulls, first_id) over all paths; one partial and one final aggregate."""
    return path_values(events).groupBy("path", "value").agg(
        F.count("*").alias("count"), F.count_if("is_null").alias("nulls"), F.min("id").alias("first_id")
    )


def facet_paths(counts: DataFrame) -> DataFrame:
    """Per path: distinct values and first appearance; single-value and time paths are left out."""
    stats = counts.groupBy("path").agg(
        F.count("*").alias("distinct_values"),
        F.min("first_id").alias("first_id"),
        F.min_by("value", F.struct("first_id", "value")).alias("first_value"),
    )
    return stats.filter((F.col("distinct_values") > 1) & ~is_time_dimension(F.col("path"), F.col("first_value")))


def field_facets(events: DataFrame, null_mode: str = "empty") -> DataFrame:
    """(path, value, count) of every facet path.

    ``null_mode="empty"`` counts nulls as the empty text; ``"drop"`` leaves them out of the counts
    but still lets them make a path multi-valued.
    """
    counts = stage_table(value_counts(events))
    kept = facet_paths(counts).select("path")
    rows = counts.join(kept, "path")
    if null_mode == "drop":
        rows = rows.withColumn("count", F.col("count") - F.col("nulls")).filter("count > 0")
    return rows.select("path", "value", "count", "first_id")


def pretty_key(path: Column) -> Column:
    """``user.id`` → ``User · Id``."""
    parts = F.transform(
        F.split(path, r"\."),
        lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.char_length(s))),
    )
    return F.array_join(parts, " · ")


def rank_facets(
    counts: DataFrame, max_groups: int = MAX_GROUPS, max_values: int = MAX_VALUES, drop_nulls: bool = False
) -> DataFrame:
    """Ranked groups and values of a ``value_counts`` table.

    Groups: fixed priority, then number of distinct values; values: by count. Ties go to what was
    seen first. The top-n windows keep ``max_values`` rows per path before the shuffle. ``drop_nulls`` takes nulls
    out of the counts before values are ranked; they still count as a value of their path.
    """
    priority = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for i, k in enumerate(KEY_PRIORITY) for x in (k, i)]), F.col("path")
        ),
        F.lit(len(KEY_PRIORITY)),
    )
    order = [F.col("_prio"), F.desc("distinct_values"), F.col("first_id"), F.col("path")]
    top = facet_paths(counts).withColumn("_prio", priority).orderBy(*order).limit(max_groups)
    # at most max_groups rows
    groups = top.withColumn("group_rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(
        "path", "group_rank"
    )
    by_count = Window.partitionBy("path").orderBy(F.desc("count"), "first_id", "value")
    if drop_nulls:
        counts = counts.withColumn("count", F.col("count") - F.col("nulls")).filter("count > 0")
    return (
        counts.join(F.broadcast(groups), "path")
        .withColumn("value_rank", F.row_number().over(by_count))
        .filter(F.col("value_rank") <= max_values)
        .select(
            F.col("path").alias("key"), pretty_key(F.col("path")).alias("label"), "group_rank", "value", "count",
            F.col("value_rank").cast("bigint").alias("value_rank"),
        )
    )


def facet_groups(
    events: DataFrame, null_mode: str = "empty", max_groups: int = MAX_GROUPS, max_values: int = MAX_VALUES
) -> DataFrame:
    """Level, source and branch groups followed by the ranked field groups, as one long table."""
    fixed = None
    # one pass over the log for the three of them
    seen = stage_table(events.groupBy("level", "source", "branch").agg(F.count("*").alias("n")))
    n = F.sum("n")
    for rank, (key, label, facet) in enumerate(
        (
            ("level", "Level", level_facet(seen, n)),
            ("source", "Source", source_facet(seen, n)),
            ("branch", "Branch", branch_facet(seen, n)),
        )
    ):
        by_count = Window.partitionBy("key").orderBy(F.desc("count"), "value")
        part = (
            facet.select(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(rank - 2).cast("bigint").alias("group_rank"),
                         F.col(key).alias("value"), "count")
            .withColumn("value_rank", F.row_number().over(by_count))
            .filter(F.col("value_rank") <= max_values)
            .withColumn("value_rank", F.col("value_rank").cast("bigint"))
        )
        fixed = part if fixed is None else fixed.unionByName(part)
    counts = stage_table(value_counts(events))
    ranked = rank_facets(counts, max_groups, max_values, drop_nulls=null_mode == "drop")
    return fixed.unionByName(ranked)


def in_scope(events: DataFrame, text: str, now_ms: int | None = None, zone: str = "UTC") -> DataFrame:
    """Events inside the filter's top-level ``ts`` bounds; other conditions do not shrink facets."""
    lo, hi = scope_bounds(text, now_ms, zone)
    if lo is not None:
        events = events.filter(F.col("ts") >= (int(lo) if lo == int(lo) else lo))
    if hi is not None:
        events = events.filter(F.col("ts") <= (int(hi) if hi == int(hi) else hi))
    return events


def scoped_facets(
    events: DataFrame, text: str, max_groups: int = MAX_GROUPS, max_values: int = MAX_VALUES, **context
) -> DataFrame:
    """Facet groups over the time scope of a filter; a bounded scope leaves nulls out of counts."""
    bounded = scope_bounds(text, **context) != (None, None)
    return facet_groups(in_scope(events, text, **context), "drop" if bounded else "empty", max_groups, max_values)


def search_facets(groups: DataFrame, text: str, shown: int = TOP_GROUPS) -> DataFrame:
    """Groups whose key, label or any value contains the text; without text the first ``shown``."""
    q = text.strip().lower()
    if not q:
        order = groups.select("key", "group_rank").distinct().orderBy("group_rank", "key").limit(shown)
        return groups.join(order.select("key"), "key", "left_semi")

    def has(c: str) -> Column:
        return F.contains(F.lower(c), F.lit(q))

    keys = groups.filter(has("key") | has("label") | has("value")).select("key").distinct()
    return groups.join(keys, "key", "left_semi")


def numeric_facets(events: DataFrame, newest: int | None = None) -> DataFrame:
    """Paths that read as measures: enough, mostly numeric, diverse. ``newest`` looks at so many events only."""
    leaves = flatten_fields(events if newest is None else events.orderBy(F.desc("id")).limit(newest))
    blank = F.try_variant_get("v", "$", "string").rlike(r"\A\s*\z") & F.to_json("v").startswith('"')
    number = F.when(~F.coalesce(blank, F.lit(False)), strict_number_of_variant(F.col("v")))
    return (
        leaves.select("path", number.alias("n"))
        .groupBy("path")
        .agg(F.count("*").alias("total"), F.count("n").alias("numeric"), F.count_distinct("n").alias("distinct_numbers"))
        .filter(
            (F.col("total") >= MIN_NUMBERS)
            & (F.col("numeric") / F.col("total") >= MIN_NUMERIC_SHARE)
            & (F.col("distinct_numbers") >= MIN_DISTINCT)
            & ~F.col("path").rlike(NOT_NUMERIC_NAME)
        )
    )


def percentile_stops(events: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(path, p, n, value) stops of every numeric path with enough values, all paths at once."""
    leaves = flatten_fields(events)
    if paths is not None:
        leaves = leaves.filter(F.col("path").isin(*paths))
    numbers = once(leaves.select("path", "v"), {"v": strict_number_of_variant(F.col("v"))})
    # read twice or more below, and far smaller than the payloads it comes from
    stops = exact_percentiles(stage_table(numbers.filter("v is not null")), ["path"], list(PERCENT_STOPS))
    return stops.filter(F.col("n") >= MIN_NUMBERS)


def facet_delta(counts: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(path, value, count) after adding and evicting events, equal to a full recount."""
    parts = counts.select("path", "value", F.col("count").alias("_d"))
    parts = parts.unionByName(value_counts(added).select("path", "value", F.col("count").alias("_d")))
    if removed is not None:
        parts = parts.unionByName(value_counts(removed).select("path", "value", (-F.col("count")).alias("_d")))
    return parts.groupBy("path", "value").agg(F.sum("_d").alias("count")).filter("count > 0")
