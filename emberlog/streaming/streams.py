"""The operators over live data.

Stateless work stays in the streaming plan. Work that spans micro-batches (groups of lines, alert
gaps, percentile filters) runs in ``foreachBatch`` with the batch operators plus a small carried
table, stored per batch number so that a replayed batch finds the same input.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from emberlog.operators import alerts as A
from emberlog.operators.coalesce import IDLE_MS, coalesce_events
from emberlog.operators.facets import path_values
from emberlog.operators.multiline import join_multiline_json
from emberlog.operators.normalise import parse_event
from emberlog.operators.relevance import match_relevance
from emberlog.operators.rules import apply_parse_rules
from emberlog.operators.search import FilterError, filter_column, read_filter, search
from emberlog.session import cut_lineage, prepare, shared_dir, small_side, stage_table
from emberlog.sources.lines import drop_blank_lines, in_live_order
from emberlog.streaming.folders import numbers, remove
from emberlog.streaming.message_index import MessageIndex
from emberlog.streaming.order_stats import JudgedStream, Limits
from emberlog.streaming.upsert import GONE, KeyedTable

#: A live source without a line for so long gives out its last groups.
QUIET_MS = 1000


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder's ``name.parquet`` files as a stream, with the schema the batch reader finds."""
    prepare(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start_stream(
    stream: DataFrame, out: str, mode: str = "append", each: Callable | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Start a query whose state is under ``out`` and return its handle; by default it runs until it is stopped.

    Rows go to Parquet under ``out`` or to ``each`` batch. ``trigger`` is what ``DataStreamWriter.trigger`` takes.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_state")
    if trigger:
        writer = writer.trigger(**trigger)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", f"{out}/rows").start()


def run_available(stream: DataFrame, out: str, mode: str = "append", each: Callable | None = None) -> StreamingQuery:
    """Process what is there and stop."""
    query = start_stream(stream, out, mode, each, {"availableNow": True})
    query.awaitTermination()
    return query


def last_batch(spark: SparkSession, out: str) -> int:
    """Number of the last batch that the query under ``out`` has committed, -1 before the first; survives restarts."""
    return max(numbers(spark, f"{out}/_state/commits"), default=-1)


def stream_events(lines: DataFrame) -> DataFrame:
    """Lines → parsed, rule-unwrapped events; one event per line, no state."""
    return apply_parse_rules(parse_event(drop_blank_lines(lines)))


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], batch.schema.names)


def with_silence(lines: DataFrame, quiet_ms: int) -> DataFrame:
    """The lines of a stream, and a row with ``_silent`` true for every source that has had none for ``quiet_ms``.

    A keyed state with a timeout on the machine's clock watches the sources. It is told of each source once per Arrow batch,
    so the lines of a hot source do not meet in its task. A source that speaks in a batch is never called silent in it.
    """

    def watch(key: tuple, told: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"source": [key[0]]})
        else:
            for _ in told:
                pass
            state.update((True,))
            state.setTimeoutDuration(quiet_ms)

    sources = lines.select("source")
    kind = sources.schema["source"].dataType.simpleString()
    quiet = (
        sources.mapInArrow(_each_once, f"source {kind}")
        .groupBy("source")
        .applyInPandasWithState(watch, f"source {kind}", "heard boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
    marks = quiet.select(
        *(F.col(f.name) if f.name == "source" else F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema),
        F.lit(True).alias("_silent"),
    )
    return lines.withColumn("_silent", F.lit(False)).unionByName(marks)


class GroupedStream:
    """Line groups over micro-batches: every group but each source's last two is final.

    The last record of a source may be cut by the batch border; once complete it can turn out to
    continue the group before it. So the lines of the last two groups are carried to the next batch that has rows;
    they are bounded by the size caps of a group. Because grouping starts afresh at a group head, carrying whole groups is
    exact, and a hot source is split by the batch operators like in a batch run. A source that ``with_silence`` calls silent
    gives out what is carried of it.
    """

    def __init__(self, spark: SparkSession, out: str, group: Callable[[DataFrame], DataFrame]):
        self.spark, self.out, self.group = spark, out, group

    def _carries(self, upto: int) -> list[int]:
        return [n for n in numbers(self.spark, f"{self.out}/carry", "b") if n <= upto]

    def _carry(self, number: int) -> str:
        return f"{self.out}/carry/b{number}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        work = stage_table(batch)
        if work.isEmpty():  # a trigger at which nothing came and nobody fell silent
            return
        quiet = None
        if "_silent" in work.columns:
            quiet = work.filter("_silent").select("source")
            work = work.filter("not _silent").drop("_silent")
        if "seq" not in work.columns:
            work = in_live_order(work, number)
        before = self._carries(number - 1)
        if before:
            work = stage_table(work.unionByName(self.spark.read.schema(work.schema).parquet(self._carry(before[-1]))))
        groups = stage_table(self.group(work))
        newest = Window.partitionBy("source").orderBy(F.desc("seq"))  # top two: limited before the shuffle
        tail = groups.select("source", "seq", F.row_number().over(newest).alias("_rn")).filter("_rn <= 2")
        last = tail.groupBy("source").agg(F.min("seq").alias("_last"))
        if quiet is not None:
            last = last.join(quiet, "source", "left_anti")
        last = small_side(cut_lineage(last))
        groups.join(last, "source", "left").filter("_last is null or seq < _last").drop("_last").write.mode("overwrite").parquet(
            f"{self.out}/rows/part={number}"
        )
        work.join(last, "source").filter("seq >= _last").drop("_last").write.mode("overwrite").parquet(
            self._carry(number)
        )
        for old in before[:-1]:  # a batch that runs again needs the one before it only
            remove(self.spark, self._carry(old))

    def finish(self) -> DataFrame:
        """End of input: close the carried groups and read all groups."""
        carries = self._carries(last_batch(self.spark, self.out))
        if carries:
            rest = self.spark.read.parquet(self._carry(carries[-1]))
            self.group(rest).write.mode("overwrite").parquet(f"{self.out}/rows/part=end")
        return self.spark.read.option("inferSchema", False).parquet(f"{self.out}/rows").drop("part")


def start_grouped(
    lines: DataFrame, out: str, group: Callable[[DataFrame], DataFrame], quiet_ms: int = QUIET_MS, trigger: dict | None = None
) -> StreamingQuery:
    """Start grouping live lines; closed groups appear under ``out/rows``, and the last ones of a source once it is silent.

    Stopped or killed, it goes on from its last committed batch when started again with the same ``out``.
    """
    grouped = GroupedStream(lines.sparkSession, out, group)
    return start_stream(with_silence(lines, quiet_ms), out, each=grouped, trigger=trigger or {"processingTime": "500 milliseconds"})


def start_join_json(lines: DataFrame, out: str, idle_ms: int | None = IDLE_MS, **how) -> StreamingQuery:
    """Multi-line JSON joined live; see ``start_grouped``."""
    return start_grouped(lines, out, lambda df: join_multiline_json(df, idle_ms), **how)


def start_coalesce(lines: DataFrame, out: str, idle_ms: int | None = IDLE_MS, **how) -> StreamingQuery:
    """Lines → joined, parsed and coalesced events, live; see ``start_grouped``."""
    return start_grouped(
        lines, out, lambda df: coalesce_events(parse_event(join_multiline_json(df, idle_ms)), idle_ms), **how
    )


def stream_join_json(lines: DataFrame, out: str, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Multi-line JSON joined over micro-batches; runs what is available and returns the lines."""
    grouped = GroupedStream(lines.sparkSession, out, lambda df: join_multiline_json(df, idle_ms))
    run_available(lines, out, each=grouped)
    return grouped.finish()


def stream_coalesce(lines: DataFrame, out: str, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Lines → joined, parsed and coalesced events over micro-batches."""
    grouped = GroupedStream(
        lines.sparkSession, out, lambda df: coalesce_events(parse_event(join_multiline_json(df, idle_ms)), idle_ms)
    )
    run_available(lines, out, each=grouped)
    return grouped.finish()


def stream_search(events: DataFrame, text: str, out: str, now_ms: int | None = None) -> DataFrame:
    """Live filter. Plain filters run in the stream; thresholds of percentile filters move with the batches.

    Events of a percentile filter are told apart by ``id``.
    """
    spark = events.sparkSession
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    try:
        found = read_filter(text, now_ms)
    except FilterError:
        found = None
    wanted = [(c.key, c.value) for c in found.leaves if c.kind == "percentile"] if found else []
    if not wanted:
        run_available(search(events, text, now_ms=now_ms), out)
        return spark.read.parquet(f"{out}/rows")

    def judge(rows: DataFrame, limits: Limits) -> DataFrame:
        return rows.withColumn(GONE, ~filter_column(found, now_ms, limits, F.lit(False), F.lit(False)))

    live = JudgedStream(spark, out, wanted, judge)
    run_available(events, out, each=live.add)
    kept = live.table.read(last_batch(spark, out))
    return spark.createDataFrame([], events.schema) if kept is None else kept.select(*events.columns)


def _upserted(counts: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode: each batch puts in the keys it changed. The table as of the last batch."""
    table = KeyedTable(counts.sparkSession, f"{out}/table", keys)
    run_available(counts, out, "update", table.upsert)
    found = table.read(last_batch(counts.sparkSession, out))
    return counts.sparkSession.createDataFrame([], counts.schema) if found is None else found


def stream_histogram(events: DataFrame, size_ms: int, out: str, watermark: str | None = None) -> DataFrame:
    """Counts per tumbling window of event time; without a watermark late events always count.

    With one, windows older than it are closed: their state goes and their row stays.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("ts"))
    if watermark:
        timed = timed.withWatermark("event_time", watermark)
    level = F.col("level")
    counts = timed.groupBy(F.window("event_time", f"{size_ms} milliseconds").alias("w")).agg(
        F.count_if(level == "error").alias("err"),
        F.count_if(level == "warn").alias("warn"),
        F.count_if(~level.isin("error", "warn")).alias("rest"),
        F.count("*").alias("total"),
    )
    rows = counts.select(F.unix_millis("w.start").alias("ts"), "err", "warn", "rest", "total")
    return _upserted(rows, out, ["ts"])


def stream_facets(events: DataFrame, out: str) -> DataFrame:
    """(path, value, count) as events arrive."""
    counts = path_values(events).groupBy("path", "value").agg(F.count("*").alias("count"))
    return _upserted(counts, out, ["path", "value"])


def stream_message_index(events: DataFrame, out: str, evicted: DataFrame | None = None) -> MessageIndex:
    """The trigram index of the messages that arrive; each batch adds what it brings.

    ``evicted`` holds events that have to leave, all of which the stream brings or has brought; they go after its last batch.
    """
    index = MessageIndex(events.sparkSession, f"{out}/index")
    run_available(events.select("msg"), out, each=lambda batch, number: index.change(2 * number, added=batch))
    if evicted is not None:
        index.change(2 * last_batch(events.sparkSession, out) + 1, evicted=evicted)
    return index


def stream_alerts(events: DataFrame, rules: list[dict], out: str, now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, fires) on arrival; the gate state is carried from batch to batch.

    Where a rule asks for percentiles, matches are those under the percentiles of all events seen; fires come
    from the events of each batch under what was seen until then.
    """
    spark = events.sparkSession
    columns = ("id", "ts", "msg", "raw", "alert_ids")
    wanted = A.rule_percentiles(rules, now_ms or 0)
    matches = events if wanted else A.match_alerts(events, rules, now_ms).select(*columns)
    states: dict[int, dict] = {}

    def judge(rows: DataFrame, limits: Limits) -> DataFrame:
        marked = rows.withColumn("alert_ids", A.alert_ids(rules, now_ms or int(time.time() * 1000), limits))
        return marked.select(*columns).withColumn(GONE, F.size("alert_ids") == 0)

    live = JudgedStream(spark, out, wanted, judge)

    def gate(batch: DataFrame, number: int) -> None:
        path = f"{out}/state/b{number - 1}"
        state = states.get(number - 1)
        if state is None and number > 0:  # restarted: read what the batch before left behind
            state = {k: tuple(v) for k, v in json.loads(spark.read.text(path).first()[0]).items()}
        batch = live.add(batch, number) if wanted else batch
        batch.write.mode("overwrite").parquet(f"{out}/matches/part={number}")
        seen = spark.read.schema(batch.schema).parquet(f"{out}/matches/part={number}")
        fires = stage_table(A.alert_fires(seen, rules, state=state))
        fires.write.mode("overwrite").parquet(f"{out}/fires/part={number}")
        states[number] = A.fire_state(seen, fires, rules, state)
        text = spark.createDataFrame([(json.dumps(states[number]),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{out}/state/b{number}")

    run_available(matches, out, each=gate)
    found, fires = (spark.read.parquet(f"{out}/{name}").drop("part") for name in ("matches", "fires"))
    if wanted:
        judged = live.table.read(last_batch(spark, out))
        found = found.limit(0) if judged is None else judged.select(*columns)
    return found, fires


class RelevantStream:
    """Matches of events against a table of patterns that may change: every event has the match that today's patterns give.

    Arriving events are kept and meet all patterns. When patterns have been added or taken away since the last look, only those meet the
    kept events; events that one of them concerns are matched anew.
    """

    KEYS = ["source", "rel_path", "line", "regex", "raw_call", "kind", "pieces"]

    def __init__(self, spark: SparkSession, out: str, patterns: Callable[[], DataFrame]):
        self.spark, self.out, self.patterns = spark, out, patterns
        self.table = KeyedTable(spark, f"{out}/matches", ["id", "source"])

    def _kept_patterns(self, version: int) -> DataFrame | None:
        found = [n for n in numbers(self.spark, f"{self.out}/patterns", "v") if n < version]
        return self.spark.read.parquet(f"{self.out}/patterns/v{found[-1]}") if found else None

    def _changed(self, now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        added, gone = (stage_table(a.join(b, self.KEYS, "left_anti")) for a, b in ((now, before), (before, now)))
        return added, gone

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.select("id", "source", "msg", "raw").write.mode("overwrite").parquet(f"{self.out}/seen/part={number}")
        self._apply(2 * number, number)

    def refresh(self) -> DataFrame:
        """Look at the patterns once more without new events, and read all matches."""
        last = last_batch(self.spark, self.out)
        if last >= 0:
            self._apply(2 * last + 1, None)
        found = self.table.read(2 * last + 1)
        return match_relevance(self._events(-1), self.patterns()) if found is None else found

    def _events(self, upto: int) -> DataFrame:
        kind = "id bigint, source string, msg string, raw string"
        if upto < 0:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(f"{kind}, part int").parquet(f"{self.out}/seen").filter(F.col("part") <= upto).drop("part")

    def _apply(self, version: int, number: int | None) -> None:
        now = stage_table(self.patterns().select(*self.KEYS).distinct())
        before = self._kept_patterns(version)
        old = self._events(version // 2 - (number is not None))
        changes = []
        if number is not None:
            new = self.spark.read.parquet(f"{self.out}/seen/part={number}")
            changes.append(match_relevance(new, now).withColumn(GONE, F.lit(False)))
        matches = self.table.read(version - 1)
        added, gone = (None, None) if before is None else self._changed(now, before)
        if before is not None and not (added.isEmpty() and gone.isEmpty()):
            touched = match_relevance(old, added).select("id", "source")
            if matches is not None:
                lost = gone.select("source", "rel_path", "line", "raw_call", "kind").distinct()
                touched = touched.unionByName(
                    matches.join(lost, ["source", "rel_path", "line", "raw_call", "kind"], "left_semi").select("id", "source")
                )
            touched = stage_table(touched.distinct())
            again = stage_table(match_relevance(old.join(touched, ["id", "source"], "left_semi"), now))
            changes.append(again.withColumn(GONE, F.lit(False)))
            none_left = touched.join(again, ["id", "source"], "left_anti")
            values = [F.lit(None).cast(f.dataType).alias(f.name) for f in again.schema if f.name not in ("id", "source")]
            changes.append(none_left.select("id", "source", *values, F.lit(True).alias(GONE)))
        if changes:
            rows = changes[0]
            for more in changes[1:]:
                rows = rows.unionByName(more)
            self.table.upsert(rows, version)
        if before is None or added is not None and not (added.isEmpty() and gone.isEmpty()):
            now.write.mode("overwrite").parquet(f"{self.out}/patterns/v{version}")


def stream_relevance(events: DataFrame, patterns: Callable[[], DataFrame], out: str) -> DataFrame:
    """Events matched against the current pattern table; a change of the table reaches earlier events too."""
    live = RelevantStream(events.sparkSession, out, patterns)
    run_available(events, out, each=live)
    return live.refresh()
