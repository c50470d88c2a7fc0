"""Reading events back: newest first, since a cursor, windows, counts, projections, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.values import variant_at
from emberlog.operators.predicates import match_free
from emberlog.operators.search import search

# Default retention, size of the shown window, limits of the text query.
RETAIN_EVENTS = 500_000
# Ranges of ids counted in one pass.
ID_RANGES = 4096
WINDOW_EVENTS = 500
TEXT_DEFAULT_LIMIT = 100
MISSING_CELL = "—"
CELL_CHARS = 80


def recent(events: DataFrame, limit: int, text: str | None = None) -> DataFrame:
    """Newest events first, optionally those whose message contains ``text``."""
    hits = events.filter(match_free(text)) if text else events
    return hits.orderBy(F.desc("id")).limit(limit)


def since(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Events after the cursor, oldest first."""
    return events.filter(F.col("id") > cursor).orderBy("id").limit(limit)


def cursor_status(events: DataFrame, cursor: int) -> DataFrame:
    """Lowest live id, live count, and whether the cursor fell behind the retained events."""
    return events.agg(F.min("id").alias("min_id"), F.count("*").alias("live")).withColumn(
        "must_resync",
        F.coalesce(F.lit(cursor > 0) & (F.col("min_id") > cursor + 1), F.lit(False)),
    )


def retain_newest(events: DataFrame, keep: int = RETAIN_EVENTS) -> DataFrame:
    """The newest ``keep`` events: those from the id on that is ``keep``-th from the top, gaps or not."""
    return events.filter(F.col("id") >= _from_top(events.select(F.col("id").cast("bigint").alias("id")), max(keep, 1)))


def _from_top(ids: DataFrame, rank: int) -> int:
    """The id that is ``rank``-th from the top, or the least one if there are fewer; found by counting, without a sort.

    Ids are counted in ``ID_RANGES`` ranges, then those of the one range that holds the rank, until that is one id.
    """
    low, high, count = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not count or count <= rank:
        return low or 0
    while low < high:
        width = -(-(high - low + 1) // ID_RANGES)
        place = F.floor((F.lit(high) - F.col("id")) / F.lit(width)).cast("int")
        ranges = (
            ids.filter(F.col("id").between(low, high)).groupBy(place.alias("r"))
            .agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        )
        found = sorted(ranges.collect())  # at most ID_RANGES small rows, from the top
        at = 0
        while found[at]["n"] < rank:
            rank -= found[at]["n"]
            at += 1
        low, high = found[at]["low"], found[at]["high"]
    return low


def retention_report(events: DataFrame, keep: int = RETAIN_EVENTS) -> DataFrame:
    """How many events stay and how many are dropped."""
    total = F.count("*")
    kept = F.least(total, F.lit(max(keep, 1)))
    return events.agg(kept.cast("bigint").alias("kept"), (total - kept).cast("bigint").alias("dropped"))


def as_of(events: DataFrame, pause_id: int) -> DataFrame:
    return events.filter(F.col("id") <= pause_id)


def new_since_pause(events: DataFrame, pause_id: int, text: str, **context) -> DataFrame:
    """Number of events past the pause that match; percentiles are taken over all events."""
    later = search(events.filter(F.col("id") > pause_id), text, over=events, **context)
    return later.agg(F.count("*").alias("new_events"))


def order_events(events: DataFrame, newest_top: bool = True) -> DataFrame:
    return events.orderBy(F.desc("id") if newest_top else F.asc("id"))


def newest_window(events: DataFrame, newest_top: bool = True, size: int = WINDOW_EVENTS) -> DataFrame:
    """The newest ``size`` events in either orientation."""
    newest = events.orderBy(F.desc("id")).limit(size)
    return newest if newest_top else newest.orderBy("id")


def match_counts(events: DataFrame, condition: Column) -> DataFrame:
    """Total and matching number of events in one pass."""
    return events.agg(F.count("*").alias("total"), F.count_if(condition).alias("filtered"))


def cell_text(value: Column) -> Column:
    """Display form of a payload value in a table cell."""
    json = F.to_json(value)
    head = F.substring(json, 1, 1)
    from emberlog.functions.values import text_of_variant

    shortened = F.when(F.char_length(json) > CELL_CHARS, F.concat(F.substring(json, 1, CELL_CHARS - 3), F.lit("…")))
    return (
        F.when(value.isNull() | (json == "null"), F.lit(MISSING_CELL))
        .when(head == "[", F.concat(F.lit("["), F.size(F.try_variant_get(value, "$", "array<variant>")).cast("string"), F.lit("]")))
        .when(head == "{", F.coalesce(shortened, json))
        .otherwise(text_of_variant(value))
    )


def project_fields(events: DataFrame, paths: list[str]) -> DataFrame:
    """Add payload paths as display columns named like the path."""
    return events.select("*", *[cell_text(variant_at(F.col("fields"), p)).alias(p) for p in paths])


def list_pins(pins: DataFrame) -> DataFrame:
    return pins.select(F.col("id").cast("bigint")).distinct().orderBy(F.desc("id"))


def pins_status(pins: DataFrame, events: DataFrame) -> DataFrame:
    """Every pin with its event, or marked evicted."""
    found = events.select("id", "level", "msg").withColumn("present", F.lit(True))
    return (
        list_pins(pins)
        .join(found.hint("merge"), "id", "left")  # a log's files are far smaller than its rows, so their size misleads
        .select("id", F.coalesce("present", F.lit(False)).alias("present"), "level", "msg")
    )


def select_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select(F.col("id").cast("bigint")), "id", "left_semi")


# The view every set of views starts with.
ALL_VIEW = {"name": "All", "query": ""}


def apply_view(events: DataFrame, view: dict = ALL_VIEW, register: bool = False, **context) -> DataFrame:
    """Apply a named saved query; ``register`` also makes it a temp view of that name."""
    result = search(events, view["query"], **context)
    if register:
        result.createOrReplaceTempView("`" + view["name"].replace("`", "``") + "`")
    return result


def agent_log_query(events: DataFrame, text: str | None = None, limit: int = TEXT_DEFAULT_LIMIT) -> DataFrame:
    """Newest events as formatted text rows under a header row (``ord`` 0), or ``no events``."""
    picked = recent(events, max(limit, 1), text)
    stamp = F.timestamp_millis("ts")
    millis = F.pmod("ts", F.lit(1000))
    rfc3339 = F.concat(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(millis == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"))),
        F.lit("+00:00"),
    )
    line = F.concat(
        F.lit("["), F.col("id").cast("string"), F.lit("] "), rfc3339, F.lit(" "), F.rpad("level", 5, " "),
        F.lit(" "), F.col("source"), F.lit("\n  "), F.col("msg"),
    )
    rows = picked.select(F.col("id").alias("ord"), line.alias("text"))
    header = picked.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("bigint").alias("ord"),
        F.when(F.col("n") == 0, F.lit("no events"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" events (most recent first)")))
        .alias("text"),
    )
    return header.unionByName(rows)
