"""Events that share a request, trace or session id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.values import text_of_variant

# Correlation keys, the first shared one wins.
CORRELATION_KEYS = ("request_id", "trace_id", "correlation_id", "span_id", "session_id")


def _keyed(events: DataFrame, *columns: str) -> DataFrame:
    """One row per event and present correlation key: prio, key, value, and whether it may anchor.

    Any kind of value can be a partner through its text form; only strings and numbers anchor. A
    missing key reads ``undefined``, so it can be the partner of an event whose id is that text.
    """
    fields = F.col("fields")

    def entry(prio: int, key: str) -> Column:
        v = F.try_variant_get(fields, f"$['{key}']", "variant")
        head = F.substring(F.to_json(v), 1, 1)
        return F.struct(
            F.lit(prio).alias("prio"), F.lit(key).alias("key"), v.alias("v"),
            F.coalesce((head == '"') | head.rlike(r"[-\d]"), F.lit(False)).alias("anchor"),
        )

    entries = F.array(*[entry(i, k) for i, k in enumerate(CORRELATION_KEYS)])
    rows = events.filter("fields is not null").select(*columns, F.explode(entries).alias("_e"))
    return rows.select(*columns, "_e.prio", "_e.key", text_of_variant(F.col("_e.v")).alias("value"), "_e.anchor")


def correlate_all(events: DataFrame) -> DataFrame:
    """(id, key, value, related): for every event its first key shared with others, and how many.

    Group sizes come from an aggregate that combines before the shuffle; no pairs are built. The
    join back is on (key, value), where the engine splits a skewed value.
    """
    keyed = _keyed(events, "id")
    sizes = keyed.groupBy("key", "value").agg(F.count("*").alias("_n")).filter("_n > 1")
    anchors = keyed.filter("anchor").drop("anchor")
    shared = anchors.join(sizes, ["key", "value"])
    return (
        shared.groupBy("id")
        .agg(F.min(F.struct("prio", "key", "value", (F.col("_n") - 1).alias("related"))).alias("_m"))
        .select("id", "_m.key", "_m.value", "_m.related")
    )


def related_events(events: DataFrame, anchor_id: int) -> DataFrame:
    """The events related to one event, with the shared key and value."""
    mine = _keyed(events.filter(F.col("id") == anchor_id), "id").filter("anchor")
    rows = mine.select("prio", "key", "value").orderBy("prio").collect()  # at most five
    out = None
    for row in rows:
        same = text_of_variant(F.try_variant_get("fields", f"$['{row['key']}']", "variant")) == row["value"]
        hits = events.filter(F.col("fields").isNotNull() & (F.col("id") != anchor_id) & same)
        out = hits.select("*", F.lit(row["key"]).alias("shared_key"), F.lit(row["value"]).alias("shared_value"))
        if not hits.isEmpty():
            return out
    return out if out is not None else events.select(
        "*", F.lit("").alias("shared_key"), F.lit("").alias("shared_value")
    ).limit(0)
