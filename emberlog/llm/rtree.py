"""Hard negatives from an R-tree packed by sort-tile-recursive.

Vectors of integers are tiled into shards: slabs by quantiles of the dimension that varies most, tiles of a slab by quantiles of the
next one. Each shard packs its rows the same way, exactly, into leaves and boxes of boxes. A box bounds
every coordinate, so the inner product of a query with any row in it lies in an interval that is a sum of intervals,
one per coordinate. A query keeps a queue of boxes, that of the largest possible score first, and drops those whose interval misses all its score
windows or stays strictly below the k-th score it has. It asks its most promising shard first; what that gives bounds the
search in the others, and shards whose outer box cannot compete are not asked.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import stage
from emberlog.llm.vectors import matrix

#: Rows of a shard, about; shards at most, whose outer boxes every task holds; rows of a leaf; children of a box.
SHARD_ROWS, MAX_SHARDS, LEAF_ROWS, FANOUT = 4096, 1 << 14, 128, 8
#: Dimensions along which a shard is tiled.
TILED = 3
#: Queries bounded or searched together.
TOGETHER = 64
LOWEST, HIGHEST = -(2**62), 2**62
REQUEST = (
    "shard int, kind int, query_id long, label int, vec array<long>, lows array<long>, highs array<long>, "
    "floors array<long>, blob binary"
)
FOUND = "query_id long, slot int, vec_id long, score long"


def packed_order(values: np.ndarray, leaf_rows: int) -> np.ndarray:
    """Order of the rows in which consecutive ``leaf_rows`` are a leaf: sort, slice, and again inside every slice."""
    varied = np.argsort(-values.var(axis=0), kind="stable")[:TILED]

    def tile(rows: np.ndarray, dimensions: np.ndarray) -> np.ndarray:
        leaves = -(-len(rows) // leaf_rows)
        if leaves <= 1 or not len(dimensions):
            return rows
        rows = rows[np.argsort(values[rows, dimensions[0]], kind="stable")]
        slices = int(np.ceil(leaves ** (1 / len(dimensions)) - 1e-9))
        size = -(-leaves // slices) * leaf_rows
        return np.concatenate([tile(rows[i : i + size], dimensions[1:]) for i in range(0, len(rows), size)])

    return tile(np.arange(len(values)), varied)


class Tree:
    """Rows in packed order, and levels of boxes from the leaves up to one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, leaf_rows: int):
        self.ids, self.labels, self.values, self.leaf_rows = ids, labels, values, leaf_rows
        low = np.minimum.reduceat(values, np.arange(0, len(values), leaf_rows))
        high = np.maximum.reduceat(values, np.arange(0, len(values), leaf_rows))
        self.boxes = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.boxes.append((low, high))

    @classmethod
    def pack(cls, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, leaf_rows: int) -> Tree:
        order = packed_order(values, leaf_rows)
        return cls(ids[order], labels[order], values[order], leaf_rows)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, labels=self.labels, values=self.values, leaf_rows=self.leaf_rows)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        held = np.load(io.BytesIO(blob))
        return cls(held["ids"], held["labels"], exact(held["values"]), int(held["leaf_rows"]))

    def bounds(self, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest possible score of every query (row) with every box (column), level by level."""
        return [intervals(asked, low, high) for low, high in self.boxes]


def intervals(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products: per coordinate the product with either end of the box, summed."""
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def exact(values: np.ndarray) -> np.ndarray:
    """Doubles where sums of products of two such rows are exact in them, since they multiply faster."""
    most = float(np.abs(values).max(initial=0))
    return values.astype(np.float64) if values.shape[1] * most * most < 2**50 else values


class Search:
    """One query's windows over a tree: the best ``k`` (score, id) of each."""

    def __init__(self, own: int, label: int, lows: np.ndarray, highs: np.ndarray, floors: np.ndarray, k: int, same: bool):
        self.own, self.label, self.k, self.same = own, label, k, same
        self.highs, self.least = highs, np.maximum(lows, floors)
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(lows)

    def competes(self, lowest: float, highest: float) -> bool:
        """Whether a box can hold a row of some window that is not strictly below its k-th score."""
        return bool(((highest >= self.least) & (lowest <= self.highs)).any())

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.least[:, None]) & (scores <= self.highs[:, None])
        fit &= ((labels == self.label) == self.same) & (ids != self.own)
        for slot in np.flatnonzero(fit.any(axis=1)):
            held_scores, held_ids = self.held[slot]
            scored = np.concatenate([held_scores, scores[fit[slot]]])
            named = np.concatenate([held_ids, ids[fit[slot]]])
            best = np.lexsort((named, -scored))[: self.k]
            self.held[slot] = scored[best], named[best]
            if len(best) == self.k:
                self.least[slot] = max(self.least[slot], scored[best[-1]])

    def run(self, tree: Tree, query: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Best-first over the boxes; the number of leaves opened. ``bounds``: this query's row of ``Tree.bounds``."""
        top, opened = len(bounds) - 1, 0
        queue = [(-bounds[top][1][0], top, 0)]
        while queue:
            highest, level, box = heapq.heappop(queue)
            if not self.competes(bounds[level][0][box], -highest):
                if -highest < self.least.min():
                    break  # so is all that follows
                continue
            if level:
                low, high = bounds[level - 1]
                for child in range(box * FANOUT, min((box + 1) * FANOUT, len(low))):
                    heapq.heappush(queue, (-high[child], level - 1, child))
            else:
                rows = slice(box * tree.leaf_rows, (box + 1) * tree.leaf_rows)
                self.take(tree.ids[rows], tree.labels[rows], tree.values[rows] @ query)
                opened += 1
        return opened


def _pack(width: int, leaf_rows: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        values = matrix(rows["vec"], np.int64, width)
        ids, labels = (rows[c].to_numpy() for c in ("vec_id", "label"))
        tree = Tree.pack(ids, labels, values, leaf_rows)
        low, high = tree.boxes[-1]
        return pa.table(
            [rows["shard"].slice(0, 1), pa.array([low[0].tolist()], pa.list_(pa.int64())), pa.array([high[0].tolist()], pa.list_(pa.int64())), pa.array([tree.dump()], pa.binary())],
            ["shard", "low", "high", "blob"],
        )

    return pack


def _lists(column: pa.Array) -> np.ndarray:
    return matrix(column, np.int64).astype(np.float64)


def _assign(boxes, width: int, rest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Requests of each query: its most promising shard, or all others that may compete."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, low, high = boxes.value
        for whole in batches:
            for begin in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(begin, TOGETHER)
                column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
                asked = matrix(column("vec"), np.int64, width)
                most = float(max(np.abs(asked).max(initial=0), np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
                kind = np.float64 if width * most * most < 2**50 else np.int64
                least, most_of = intervals(asked.astype(kind), low.astype(kind), high.astype(kind))
                lows, highs, floors = (column(c).to_pylist() for c in ("lows", "highs", "floors"))
                home = column("home").to_pylist()
                at, to = [], []
                for i in range(batch.num_rows):
                    lowest = np.maximum(lows[i], floors[i])[:, None]
                    alive = ((most_of[i] >= lowest) & (least[i] <= np.array(highs[i])[:, None])).any(axis=0)
                    if rest:
                        found = np.flatnonzero(alive & (shards != home[i]))
                    else:
                        found = np.flatnonzero(alive)
                        found = found[np.argmax(most_of[i][found])][None] if len(found) else found
                    at += [i] * len(found)
                    to += shards[found].tolist()
                rows = batch.take(pa.array(at, pa.int64()))
                names = ["query_id", "label", "vec", "lows", "highs", "floors"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to, pa.int32()), pa.array([1] * len(to), pa.int32()),
                        *(rows.column(rows.schema.get_field_index(c)) for c in names), pa.nulls(len(to), pa.binary()),
                    ],
                    ["shard", "kind", *names, "blob"],
                )

    return assign


def _answer(k: int, same: bool, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come shard by shard, its tree first; queries stream past it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, tree = None, None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            starts = sorted({0, *np.flatnonzero(kinds == 0).tolist(), *(np.flatnonzero(kinds == 0) + 1).tolist()})
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                if begin < end and kinds[begin] == 0:
                    blob, tree = batch.column(8)[begin].as_py(), None
                    continue
                for at in range(begin, end, TOGETHER):
                    tree = tree or Tree.load(blob)
                    yield _asked(tree, batch.slice(at, min(TOGETHER, end - at)), k, same, width)

    return answer


def _asked(tree: Tree, batch: pa.RecordBatch, k: int, same: bool, width: int) -> pa.RecordBatch:
    ids, labels = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    asked = matrix(batch.column(4), np.int64, width)
    if tree.values.dtype == np.float64 and width * np.abs(asked).max(initial=0) * np.abs(tree.values).max(initial=0) < 2**50:
        asked, values = asked.astype(np.float64), tree.values
    else:
        values = tree.values.astype(np.int64)
    if values is not tree.values:
        tree = Tree(tree.ids, tree.labels, values, tree.leaf_rows)
    bounds = tree.bounds(asked)
    lows, highs, floors = (batch.column(c).to_pylist() for c in (5, 6, 7))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i, own in enumerate(ids):
        search = Search(own, labels[i], *(np.array(x[i], np.int64) for x in (lows, highs, floors)), k, same)
        search.run(tree, asked[i], [(low[i], high[i]) for low, high in bounds])
        for slot, (scores, found) in enumerate(search.held):
            out[0].extend([own] * len(found))
            out[1].extend([slot] * len(found))
            out[2].extend(found.tolist())
            out[3].extend(map(int, scores))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query_id", "slot", "vec_id", "score"])


class Forest:
    """Packed shards of ``rows`` (vec_id, label, vec), staged, and their outer boxes."""

    def __init__(self, rows: DataFrame, shard_rows: int, max_shards: int, leaf_rows: int):
        self.spark = rows.sparkSession
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()))
        count, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.width = width or 0
        shards = min(max_shards, max(1, -(-count // shard_rows)))
        dealt = self._tiled(rows, shards).select("shard", "vec_id", "label", "vec")
        schema = "shard int, low array<long>, high array<long>, blob binary"
        self.trees = stage(dealt.groupBy("shard").applyInArrow(_pack(self.width, leaf_rows), schema))
        # at most ``max_shards`` rows of two boxes' corners
        boxes = self.trees.select("shard", "low", "high").toArrow()
        self.boxes = self.spark.sparkContext.broadcast(
            (boxes["shard"].to_numpy(), matrix(boxes["low"], np.int64, self.width), matrix(boxes["high"], np.int64, self.width))
        )

    def _tiled(self, rows: DataFrame, shards: int) -> DataFrame:
        """Add ``shard``: sort-tile by quantiles of the two dimensions that vary most; equal values are dealt out by row."""
        if shards == 1:
            return rows.withColumn("shard", F.lit(0))
        spread = (
            rows.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v"))
            .orderBy(F.col("v").desc(), "d").limit(2).collect()
        )
        dimensions = [r["d"] for r in spread] or [0]
        # components are integers, so a fraction from the row's number only parts equal ones
        fraction = lambda salt: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(1 << 20)) / F.lit(1 << 20)
        key = lambda d, salt: F.coalesce(F.get("vec", F.lit(d)), F.lit(0)) + fraction(salt)
        slabs = int(np.ceil(shards**0.5))
        tiles = -(-shards // slabs)
        keyed = rows.withColumns({"_a": key(dimensions[0], 1), "_b": key(dimensions[-1], 2)})
        cut = lambda c, n: F.percentile_approx(c, [i / n for i in range(1, n)], 10_000)
        place = lambda c, cuts: F.size(F.filter(cuts, lambda x: x <= F.col(c)))
        edges = keyed.agg(cut("_a", slabs).alias("e")).first()["e"]
        keyed = keyed.withColumn("_slab", place("_a", F.array(*map(F.lit, edges))))
        if tiles == 1:
            return keyed.withColumn("shard", F.col("_slab"))
        inner = keyed.groupBy("_slab").agg(cut("_b", tiles).alias("_cuts"))  # one row per slab
        return keyed.join(F.broadcast(inner), "_slab").withColumn("shard", (F.col("_slab") * tiles + place("_b", F.col("_cuts"))).cast("int"))

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """``query_id, slot, vec_id, score, rank`` of the best ``k`` rows of the query's label (``same``) or of all other labels.

        ``queries``: query_id, label, vec, and arrays lows and highs with a score window per slot.
        """
        if not len(self.boxes.value[0]):
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        asked = queries.withColumns({"floors": F.transform("lows", lambda _: F.lit(LOWEST)), "home": F.lit(-1)})
        home = stage(asked.mapInArrow(_assign(self.boxes, self.width, False), REQUEST))
        first = stage(self._answers(home, k, same))
        order = Window.partitionBy("query_id", "slot").orderBy(F.col("score").desc(), "vec_id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        kth = first.groupBy("query_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        floors = kth.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("_kth"))
        raised = F.transform("floors", lambda x, i: F.coalesce(F.col("_kth")[i], x))
        again = (
            home.select("query_id", "label", "vec", "lows", "highs", "floors", F.col("shard").alias("home"))
            .join(floors, "query_id", "left").withColumn("floors", raised).drop("_kth")
        )
        further = self._answers(again.mapInArrow(_assign(self.boxes, self.width, True), REQUEST), k, same)
        return ranked(first.unionByName(further)).withColumn("rank", F.col("rank").cast("int"))

    def _answers(self, requests: DataFrame, k: int, same: bool) -> DataFrame:
        null = lambda kind: F.lit(None).cast(kind)
        trees = self.trees.select(
            "shard", F.lit(0).alias("kind"), null("long").alias("query_id"), null("int").alias("label"),
            *(null("array<long>").alias(c) for c in ("vec", "lows", "highs", "floors")), "blob",
        )
        dealt = trees.unionByName(requests).repartition("shard").sortWithinPartitions("shard", "kind")
        return dealt.mapInArrow(_answer(k, same, self.width), FOUND)


def labelled_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with an id, a label and only finite components; components as floor(scale * x)."""
    vec = F.col(vector_col).cast("array<double>")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))


def hard_negatives(
    vectors: DataFrame,
    relabel: Callable[[DataFrame], Column] | None = None,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shard_rows: int = SHARD_ROWS,
    max_shards: int = MAX_SHARDS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels in the window.

    Anchors are the rows whose id is divisible by ``every``. Scores are integer inner products of components counted as floor(scale * x). A
    negative's score times 100 lies within ``window`` times the positive's score. Higher scores come first, ties go to the smaller id.
    Returns anchor_id, positive_id, positive_rank, rank, negative_id, positive_score and negative_score. Rows with a null id or label, a null vector, or
    null or non-finite components take no part; missing components of a shorter vector count as 0. Rows that repeat an id are separate
    candidates for others, and never for themselves; the smallest (vector, label) of them is the anchor. ``relabel`` gives the label
    column to use. Scores are exact while they fit 62 bits. No rows in: no rows out.
    """
    rows = labelled_vectors(vectors, scale, id_col, vector_col, label_col)
    if relabel:
        rows = rows.withColumn("label", relabel(rows).cast("int"))
    forest = Forest(rows, shard_rows, max_shards, leaf_rows)
    anchors = stage(
        rows.filter(F.col("vec_id") % every == 0)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min(F.struct("vec", "label")).alias("own"))
        .select("query_id", "own.label", "own.vec")
    )
    all_scores = {"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))}
    same = stage(forest.best(anchors.withColumns(all_scores), positives, True))
    low, high = window
    score = F.col("score")
    # the least and greatest integers between the two products
    windows = same.select(
        "query_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("positive_rank"), score.alias("positive_score"),
        (-F.floor(-(score * low).cast("decimal(38,0)") / 100)).cast("long").alias("low"),
        F.floor((score * high).cast("decimal(38,0)") / 100).cast("long").alias("high"),
    ).filter(F.col("low") <= F.col("high"))
    slots = windows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score", "low", "high"))).alias("pairs"))
    slots = stage(slots)
    asking = anchors.join(slots, "query_id").select("query_id", "label", "vec", F.col("pairs.low").alias("lows"), F.col("pairs.high").alias("highs"))
    found = forest.best(asking, negatives, False)
    pair = F.get("pairs", F.col("slot"))
    return found.join(slots, "query_id").select(
        F.col("query_id").alias("anchor_id"), pair["positive_id"].alias("positive_id"), pair["positive_rank"].alias("positive_rank"),
        "rank", F.col("vec_id").alias("negative_id"), pair["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def rotated_label(rows: DataFrame) -> Column:
    """One row in seven takes the next of ten labels, as when labels are noisy."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


HARD_NEGATIVES_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
