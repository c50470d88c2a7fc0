"""Alert rules: which events match, and which matches notify."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.search import FilterError, filter_column, read_filter, thresholds_of
from emberlog.session import stage_table

# Least gap between notifications, defaults of a rule, length of the notice text.
MIN_GAP_MS = 5_000
DEFAULT_COLOR = "red"
NOTICE_CHARS = 120
CHUNK_IDS = 1_000_000
NEVER = -(1 << 62)


def normalise_alert_rules(rules: DataFrame, rule: str = "rule", now_ms: int | None = None) -> DataFrame:
    """Rules stored as VARIANT objects → typed rules with defaults; malformed rules are dropped."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms

    def part(name: str) -> tuple[Column, Column]:
        v = F.try_variant_get(rule, f"$.{name}", "variant")
        return v, F.substring(F.to_json(v), 1, 1)

    def text(name: str) -> Column:
        v, head = part(name)
        return F.when(head == '"', F.try_variant_get(v, "$", "string"))

    def number(name: str) -> Column:
        v, head = part(name)
        return F.when(head.rlike(r"[-\d]"), F.try_variant_get(v, "$", "double"))

    keep = [c for c in rules.columns if c != rule]
    return rules.select(
        *keep, text("id").alias("id"), text("name").alias("name"), text("query").alias("query"),
        F.coalesce(text("color"), F.lit(DEFAULT_COLOR)).alias("color"),
        F.coalesce(part("notify")[1] == "t", F.lit(False)).alias("notify"),
        F.greatest(F.coalesce(number("debounce_ms"), F.lit(0.0)), F.lit(float(MIN_GAP_MS))).cast("bigint").alias("debounce_ms"),
        F.coalesce(part("enabled")[1] != "f", F.lit(True)).alias("enabled"),
        F.coalesce(number("created_at").cast("bigint"), F.lit(now_ms)).alias("created_at"),
    ).filter("id is not null and name is not null and query is not null")


def _usable(rules: list[dict], now_ms: int) -> list[tuple[dict, object]]:
    out = []
    for r in rules:
        if r.get("enabled", True):
            try:
                out.append((r, read_filter(r["query"], now_ms)))
            except FilterError:
                continue
    return out


def match_alerts(
    events: DataFrame,
    rules: list[dict],
    now_ms: int | None = None,
    over: DataFrame | None = None,
    limits: dict[tuple[str, float], float] | None = None,
) -> DataFrame:
    """Events with the ids of the enabled rules they match, in rule order (``alert_ids``).

    Percentiles are taken over ``over`` (default ``events``), or are known as ``limits``.

    One pass: every rule is a condition on the row. Unreadable rules are skipped; pins and
    relevance read as false here.
    """
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    usable = _usable(rules, now_ms)
    if limits is None:
        limits = thresholds_of(over if over is not None else events, *[f for _, f in usable])
    return events.withColumn("alert_ids", _alert_ids(usable, now_ms, limits)).filter(F.size("alert_ids") > 0)


def _alert_ids(usable: list[tuple[dict, object]], now_ms: int, limits: dict[tuple[str, float], float]) -> Column:
    hits = [F.when(filter_column(f, now_ms, limits), F.lit(r["id"])) for r, f in usable]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def alert_ids(rules: list[dict], now_ms: int, limits: dict[tuple[str, float], float]) -> Column:
    """Ids of the enabled rules that a row matches under known thresholds; an empty array for none."""
    return _alert_ids(_usable(rules, now_ms), now_ms, limits)


def rule_percentiles(rules: list[dict], now_ms: int = 0) -> list[tuple[str, float]]:
    """(key, percent) pairs that the enabled rules ask for."""
    return sorted({(c.key, c.value) for _, f in _usable(rules, now_ms) for c in f.leaves if c.kind == "percentile"})


def rules_aggregate(rules: list[dict], now_ms: int = 0) -> bool:
    """Whether any usable rule depends on the distribution of all events."""
    return any(f.aggregates for _, f in _usable(rules, now_ms))


def match_alerts_delta(
    earlier: DataFrame, new_events: DataFrame, all_events: DataFrame, rules: list[dict], now_ms: int | None = None
) -> DataFrame:
    """(id, alert_ids) after new events: earlier matches plus theirs, or a full recompute where needed."""
    if rules_aggregate(rules):
        return match_alerts(all_events, rules, now_ms).select("id", "alert_ids")
    fresh = match_alerts(new_events, rules, now_ms).select("id", "alert_ids")
    return earlier.select("id", "alert_ids").unionByName(fresh)


def primary_alert(matches: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, alert_id, color): the first matching alert of each event."""
    colors = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r.get("color") or DEFAULT_COLOR)])
    first = F.element_at("alert_ids", 1)
    return matches.select("id", first.alias("alert_id"), F.try_element_at(colors, first).alias("color"))


def alert_fires(
    matches: DataFrame, rules: list[dict], chunk_ids: int = CHUNK_IDS, state: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Notifications in id order with event time as the clock: (id, alert_id, ts, suppressed, title, body).

    ``state`` continues an earlier run: alert id → (time of its last fire, matches suppressed since).

    A match fires when its alert and all alerts together have been quiet long enough. Only matches
    whose ``ts`` exceeds every earlier one of the same alert can ever fire, so those are folded, in
    chunks of ids that run in parallel. A match behind a quiet gap fires whatever was notified before and leaves
    a state that owes nothing to it, so what a chunk ends with follows from its last such match; one pass
    knows all starts. Only chunks without any gap start from what their predecessor ended with in the
    round before, until no start changes: the number of jobs grows with the longest run of such chunks, not with
    the ids. Counts of suppressed matches are differences of positions and need no fold.
    """
    notifying = [r for r in rules if r.get("notify")]
    order = {r["id"]: i for i, r in enumerate(notifying)}
    gaps = [max(int(r.get("debounce_ms") or 0), MIN_GAP_MS) for r in notifying]
    spark = matches.sparkSession
    schema = "id bigint, alert_id string, ts bigint, suppressed bigint, title string, body string"
    if not notifying:
        return spark.createDataFrame([], schema)
    matches = stage_table(matches.select("id", "ts", "msg", "raw", "alert_ids"))
    number = F.try_element_at(F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)]), F.col("alert_id"))
    hits = (
        matches.select("id", "ts", F.posexplode("alert_ids").alias("ord", "alert_id"))
        .withColumn("a", number)
        .filter("a is not null")
        .withColumn("chunk", F.floor(F.col("id") / chunk_ids))
    )
    state = state or {}
    begin = [state.get(r["id"], (NEVER, 0))[0] for r in notifying]

    def of_alert(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("a"))

    # a later match of another alert waits five seconds anyway, and only what its own gap asks beyond that
    block = [max(MIN_GAP_MS, g - MIN_GAP_MS) for g in gaps]
    first = max(b + w for b, w in zip(begin, block))
    # one summary row per chunk and alert; fires are at least five seconds apart
    earlier = Window.partitionBy("a").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage_table(
        hits.groupBy("chunk", "a")
        .agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_last", F.greatest(F.max("_ts").over(earlier), of_alert(begin)))
    )
    blocked = sizes.groupBy("chunk").agg(F.max(F.col("_ts") + of_alert(block)).alias("_until"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    blocked = blocked.select("chunk", F.greatest(F.max("_until").over(in_order), F.lit(first)).alias("_until"))
    mine = Window.partitionBy("chunk", "a").orderBy("id")
    every = Window.partitionBy("chunk").orderBy("id", "ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = hits.withColumn("rn", F.row_number().over(mine)).withColumn(
        "_top", F.max("ts").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    )
    placed = placed.filter("_top is null or ts > _top").join(sizes.select("chunk", "a", "_last"), ["chunk", "a"])
    placed = placed.withColumn("_top", F.greatest("_top", "_last")).filter("ts > _top").join(blocked, "chunk")
    placed = placed.withColumn("_until", F.greatest("_until", F.max(F.col("ts") + of_alert(block)).over(every)))
    # additions only: NEVER is far from the ends of a long, but a difference from it is not worth trusting
    cut = (F.col("ts") >= F.col("_until")) & (F.col("ts") >= F.col("_top") + of_alert(gaps))
    records = stage_table(placed.select("chunk", "id", "ord", "a", "ts", "rn", cut.alias("cut")))

    def fold(rows: pd.DataFrame, last: np.ndarray, any_last: int) -> tuple[list[int], np.ndarray, int]:
        fired = []
        for i, (a, ts) in enumerate(zip(rows["a"].to_numpy(), rows["ts"].to_numpy())):
            if ts - last[a] >= gaps[a] and ts - any_last >= MIN_GAP_MS:
                last[a] = any_last = ts
                fired.append(i)
        return fired, last, any_last

    def started(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        rows = rows.sort_values(["id", "ord"], kind="stable").reset_index(drop=True)
        return rows, np.array(rows["last"].iloc[0], dtype=np.int64), int(rows["any_last"].iloc[0])

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, any_last = started(rows)
        free = np.flatnonzero(rows["cut"].to_numpy())
        if len(free):
            rows, last, any_last = rows.iloc[free[-1]:], np.full(len(gaps), NEVER, dtype=np.int64), NEVER
        _, last, any_last = fold(rows, last, any_last)
        head = {"chunk": rows["chunk"].iloc[0], "free": len(free) > 0}
        return pd.DataFrame([{**head, "last": last.tolist(), "any_last": any_last}])

    def fires(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, any_last = started(rows)
        fired, _, _ = fold(rows, last, any_last)
        return rows.loc[fired, ["chunk", "id", "a", "ts", "rn"]]

    state_schema = "chunk bigint, last array<bigint>, any_last bigint"
    exit_schema = "chunk bigint, free boolean, last array<bigint>, any_last bigint"
    fresh = ([NEVER] * len(gaps), NEVER)
    chunks = [r[0] for r in records.select("chunk").distinct().orderBy("chunk").collect()]  # one per million ids
    starts = {c: fresh for c in chunks}
    if chunks:
        starts[chunks[0]] = (begin, max(begin))
    ends: dict[int, tuple[list[int], int]] = {}
    settled = set(chunks[-1:])  # chunks whose end nobody asks for, or does not depend on their start
    todo = chunks[:-1]
    while todo:
        table = spark.createDataFrame([(c, *starts[c]) for c in todo], state_schema)
        for r in records.join(table, "chunk").groupBy("chunk").applyInPandas(exits, exit_schema).collect():
            ends[r["chunk"]] = (list(r["last"]), r["any_last"])
            if r["free"]:
                settled.add(r["chunk"])
        moved = []
        for before, c in zip(chunks, chunks[1:]):
            if ends[before] != starts[c]:
                starts[c] = ends[before]
                moved.append(c)
        todo = [c for c in moved if c not in settled]
    if not chunks:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(c, *starts[c]) for c in chunks], state_schema)
    found = records.join(table, "chunk").groupBy("chunk").applyInPandas(
        fires, "chunk bigint, id bigint, a int, ts bigint, rn int"
    )
    by_alert = Window.partitionBy("a").orderBy("id")
    carried = F.array(*[F.lit(state.get(r["id"], (NEVER, 0))[1]).cast("bigint") for r in notifying])
    counted = (
        found.join(sizes.select("chunk", "a", "_before"), ["chunk", "a"])
        .withColumn("_at", F.col("_before") + F.col("rn"))
        .withColumn("suppressed", F.col("_at") - F.coalesce(F.lag("_at").over(by_alert), -F.get(carried, F.col("a"))) - 1)
    )
    names = F.array(*[F.lit(r["id"]) for r in notifying])
    titles = F.array(*[F.lit(r.get("name") or r["id"]) for r in notifying])
    head = F.substring(F.when(F.col("msg") != "", F.col("msg")).otherwise(F.col("raw")), 1, NOTICE_CHARS)
    more = F.concat(head, F.lit("\n+"), F.col("suppressed").cast("string"), F.lit(" more"))
    return counted.join(matches.select("id", "msg", "raw"), "id").select(
        "id", F.get(names, F.col("a")).alias("alert_id"), "ts", "suppressed",
        F.get(titles, F.col("a")).alias("title"),
        F.when(F.col("suppressed") > 0, more).otherwise(head).alias("body"),
    )


def fire_state(
    matches: DataFrame, fires: DataFrame, rules: list[dict], state: dict[str, tuple[int, int]] | None = None
) -> dict[str, tuple[int, int]]:
    """State after a run, for the next one: alert id → (time of its last fire, matches suppressed since)."""
    out = dict(state or {})
    hits = matches.select("id", F.explode("alert_ids").alias("alert_id"))
    last = fires.groupBy("alert_id").agg(F.max("id").alias("fired"), F.max("ts").alias("ts"))
    later = hits.join(last, "alert_id", "left").groupBy("alert_id").agg(
        F.max("ts").alias("ts"), F.count_if(F.coalesce(F.col("id") > F.col("fired"), F.lit(True))).alias("waiting")
    )
    for r in later.collect():  # one row per alert
        before = out.get(r["alert_id"], (NEVER, 0))
        fired = r["ts"] is not None
        out[r["alert_id"]] = (r["ts"] if fired else before[0], r["waiting"] + (0 if fired else before[1]))
    return out
