"""Minimax contiguous partition: ordered groups of equal texts are cut into shards of least largest size.

Everything here is DataFrame or SQL functions. Groups (rows with one text) are atomic and ordered by their
smallest id. The smallest feasible shard capacity is found by binary search with a greedy check, both inside
one SQL expression over a bounded list of cut positions:

* a cut position is the size total up to and with some group;
* first the sequence is divided in ``cells`` equal stretches and only the last position of each may be cut.
  That answer is at most one stretch too large, so the true cuts lie in known narrow intervals;
* stretches near those intervals that hold more positions are divided again, until none does. The last answer is
  exact.

Each round adds at most a list of twice ``cells`` numbers and narrows the stretches many times over, so a table of any
number of groups takes a handful of rounds and nothing that grows with the table reaches one task.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import shuffle_width, stage

#: Cut positions looked at together; bounds the list that a round returns.
CELLS = 32_768


def _greedy_shards(ends: Column, capacity: Column) -> Column:
    """Shards that a greedy walk over the ascending cut positions needs; 2**31 if one step exceeds the capacity."""
    begin = F.struct(
        F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("used")
    )

    def step(acc: Column, end: Column) -> Column:
        cut = end - acc["opened"] > capacity
        opened = F.when(cut, acc["last"]).otherwise(acc["opened"])
        used = acc["used"] + F.when(cut, 1).otherwise(0) + F.when(end - opened > capacity, 2**31).otherwise(0)
        return F.struct(opened.alias("opened"), end.alias("last"), used.cast("long").alias("used"))

    return F.aggregate(ends, begin, step, lambda acc: acc["used"] + 1)


def _least_capacity(ends: Column, low: Column, high: Column, shards: int, rounds: int) -> Column:
    """Binary search for the smallest capacity in [low, high] for which the greedy walk needs at most ``shards``."""
    begin = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    def narrowed(acc: Column, middle: Column) -> Column:
        return F.when(
            _greedy_shards(ends, middle) <= shards, F.struct(acc["low"].alias("low"), middle.alias("high"))
        ).otherwise(F.struct((middle + 1).alias("low"), acc["high"].alias("high")))

    def halve(acc: Column, _: Column) -> Column:
        # an array of one element names the middle, so that it is computed once
        middle = F.array((acc["low"] + F.floor((acc["high"] - acc["low"]) / 2)).cast("long"))
        return F.element_at(F.transform(middle, lambda m: narrowed(acc, m)), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, halve, lambda acc: acc["high"])


def _cuts(ends: Column, capacity: Column) -> Column:
    """Positions where the greedy walk with ``capacity`` closes a shard, the last position left out."""
    begin = F.struct(
        F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("cuts")
    )

    def step(acc: Column, end: Column) -> Column:
        cut = end - acc["opened"] > capacity
        return F.struct(
            F.when(cut, acc["last"]).otherwise(acc["opened"]).alias("opened"),
            end.alias("last"),
            F.when(cut, F.concat(acc["cuts"], F.array(acc["last"]))).otherwise(acc["cuts"]).alias("cuts"),
        )

    return F.aggregate(ends, begin, step, lambda acc: acc["cuts"])


def _intervals(ends: list[int], open_cells: list[tuple[int, int]], low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Disjoint intervals that hold every cut of a greedy walk with a capacity in [low, high].

    ``ends`` are positions known so far, ``open_cells`` stretches (first and last known position) that hold more.
    """
    found: list[tuple[int, int]] = []
    firsts = [a for a, _ in open_cells]
    least = most = 0
    for _ in range(shards):
        least = ends[max(0, bisect_right(ends, least + low) - 1)] if ends[0] <= least + low else least
        reach = most + high
        within = bisect_right(firsts, reach) - 1
        if within >= 0 and reach < open_cells[within][1]:
            most = reach
        elif ends[0] <= reach:
            most = ends[bisect_right(ends, reach) - 1]
        if found and least <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], most))
        else:
            found.append((least, most))
    return found


def ordered_positions(groups: DataFrame) -> DataFrame:
    """Add ``end``: the size total over all groups up to and with this one, in order of ``first_id``.

    Range partitions are summed side by side; the offsets come from one row per partition.
    """
    spark = groups.sparkSession
    dealt = groups.repartitionByRange(shuffle_width(spark), "first_id", "text_key")
    dealt = stage(dealt.withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum("group_size").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("first_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.join(F.broadcast(offsets), "_part")  # at most as many rows as there are partitions
        .withColumn("end", F.col("_offset") + F.sum("group_size").over(inside))
        .drop("_part", "_offset")
    )


def minimax_cuts(positions: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """Smallest feasible capacity over the positions (``end``, ``group_size``), and where the greedy walk cuts."""
    facts = positions.agg(F.max("end"), F.max("group_size")).first()
    if facts[0] is None:
        return 0, []
    total, largest = facts
    low, high = max(largest, -(-total // shards)), total
    looked_at, known, width, span = positions, None, 0, total
    while True:
        # at least half as wide as before, so that the search ends
        width = max(1, min(-(-span // cells), width // 2 or span))
        cell = F.floor((F.col("end") - 1) / width)
        found = looked_at.groupBy(cell.alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
        found = stage(found if known is None else found.unionByName(known))
        both = F.flatten(F.collect_list(F.array("first", "last")))
        is_open = F.col("first") < F.col("last")
        listed = stage(
            found.agg(
                F.array_sort(F.array_distinct(F.concat(both, F.array(F.lit(total).cast("long"))))).alias("ends"),
                F.array_sort(F.collect_list(F.when(is_open, F.struct("first", "last")))).alias("open_cells"),
            )
        )
        # cuts kept to the listed positions may need a larger capacity than the true ones, by one stretch at most
        upper = min(high + width, total)
        halvings = (upper - low + 1).bit_length()
        capacity = listed.select(
            _least_capacity(F.col("ends"), F.lit(low), F.lit(upper), shards, halvings).alias("capacity")
        ).first()[0]
        row = listed.select("*", _cuts(F.col("ends"), F.lit(capacity).cast("long")).alias("cuts")).first()
        if not row["open_cells"]:
            return capacity, row["cuts"]
        high = min(high, capacity)
        low = max(low, capacity - width)
        spans = _intervals(row["ends"], [(c["first"], c["last"]) for c in row["open_cells"]], low, high, shards)
        near = reduce(or_, ((F.col("first") <= b) & (F.col("last") >= a) for a, b in spans))
        still_open = found.filter(is_open & near)
        known = found.filter(~is_open & near).unionByName(
            # the outer positions of an open stretch are known already
            still_open.select("cell", F.explode(F.array("first", "last")).alias("first")).withColumn("last", F.col("first"))
        )
        looked_at = looked_at.withColumn("cell", cell).join(still_open, "cell").filter(
            (F.col("end") > F.col("first")) & (F.col("end") < F.col("last"))
        ).select("end")
        span = still_open.agg(F.sum(F.col("last") - F.col("first"))).first()[0] or 1


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, cells: int = CELLS
) -> DataFrame:
    """Put every row in a shard so that the largest shard is as small as contiguous, whole groups allow.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. A row's size is the UTF-8 length of its
    text (null: 0) plus ``overhead``. Rows with equal texts form one group and stay together; a null text is equal
    to other null texts only. Rows with one id and one text are separate rows of the group, each with a slot.
    An empty table gives no rows. Other columns are not looked at, so their names cannot clash.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")).alias("text_key"),
        )
    )
    groups = rows.groupBy("text_key").agg(F.min("id").alias("first_id"), F.sum("size").alias("group_size"))
    positions = stage(ordered_positions(groups))
    _, cuts = minimax_cuts(positions, shards, cells)
    passed = F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda cut: cut < F.col("end"))
    shard = F.size(passed) if cuts else F.lit(0)
    placed = rows.join(positions.select("text_key", shard.cast("int").alias("shard")), "text_key")
    # slots: numbered inside buckets of ids, with the counts of earlier buckets added
    buckets = shuffle_width(spark)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("id", "text_key", "size"), F.lit(buckets)))
    placed = stage(placed.drop("text_key"))
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("id", "text_crc32")
    return placed.join(counts, ["shard", "_bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
