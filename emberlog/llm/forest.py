"""Approximate nearest neighbours by cosine in a forest of random-projection trees.

The trees are fitted on a bounded sample; every row is then filed in one leaf of each tree. A query keeps one
priority queue over all trees: the branch whose dividing planes lie nearest to it comes next, until the leaves seen
hold a share of all rows. The share is measured: the exact neighbours of some rows say how far the queue has to go.
The rows of the leaves seen are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import stage
from emberlog.llm.vectors import best_of_query, bucket, matrix, queries_of, usable

#: The trees are fitted on at most so many rows, those of least hash of the id.
SAMPLE_ROWS = 16384
TREES = 8
#: Rows of a leaf, about; the sample allows 2**MAX_DEPTH leaves a tree.
LEAF_ROWS = 64
MAX_DEPTH = 9
#: Leaves are opened until, were trees independent, they would hold so large a share of all rows that this part
#: of the exact neighbours of PILOT_ROWS rows, those of least hash of the id, is among them.
RECALL = 0.95
PILOT_ROWS = 192
#: Larger leaves are worked on in blocks of about so many rows.
BLOCK_ROWS = 4096
FOUND = "query_id long, vec_id long, score double"


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Planes (trees x nodes x width) and offsets of complete trees; a plane lies between two sample rows of its node."""
    rng = np.random.default_rng(seed)
    nodes = 2**depth - 1
    planes, offsets = np.zeros((trees, nodes, sample.shape[1])), np.zeros((trees, nodes))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = members.pop(node)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
            else:
                plane = rng.standard_normal(sample.shape[1])
            norm = np.linalg.norm(plane)
            planes[tree, node] = plane / norm if norm > 1e-12 else rng.standard_normal(sample.shape[1]) / sample.shape[1] ** 0.5
            side = sample[rows] @ planes[tree, node]
            offsets[tree, node] = np.median(side) if len(rows) else 0.0
            members[2 * node + 1] = rows[side <= offsets[tree, node]]
            members[2 * node + 2] = rows[side > offsets[tree, node]]
    return planes, offsets


def leaves_of(unit: np.ndarray, planes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Leaf of each row in each tree (rows x trees)."""
    trees, nodes, _ = planes.shape
    out = np.zeros((len(unit), trees), np.int32)
    for tree in range(trees):
        node = np.zeros(len(unit), np.int64)
        while nodes and len(node) and node[0] < nodes:
            side = np.einsum("ij,ij->i", unit, planes[tree, node])
            node = 2 * node + 1 + (side > offsets[tree, node])
        out[:, tree] = node - nodes
    return out


def _queue(
    query: np.ndarray, planes: np.ndarray, offsets: np.ndarray, shares: np.ndarray
) -> Iterator[tuple[int, int, float]]:
    """Leaves (tree, leaf) in the order of one priority queue over all trees, each with the share held by those before it."""
    trees, nodes, _ = planes.shape
    margins = planes @ query - offsets
    queue = [(0.0, tree, 0) for tree in range(trees)]
    left = np.ones(trees)
    reached = 0.0
    while queue:
        distance, tree, node = heapq.heappop(queue)
        if node >= nodes:
            if shares[tree, node - nodes] > 0:
                yield tree, node - nodes, reached
                left[tree] = max(0.0, left[tree] - shares[tree, node - nodes])
                reached = float(1 - left.prod())
            continue
        margin = margins[tree, node]
        near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
        heapq.heappush(queue, (distance, tree, near))
        heapq.heappush(queue, (max(distance, abs(margin)), tree, far))


def probes_of(
    query: np.ndarray, planes: np.ndarray, offsets: np.ndarray, shares: np.ndarray, wanted: float
) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of the queue, until they hold the wanted share."""
    return [(t, x) for t, x, _ in takewhile(lambda o: o[2] < wanted, _queue(query, planes, offsets, shares))]


def share_for(
    pilots: np.ndarray, near: list[np.ndarray], planes: np.ndarray, offsets: np.ndarray, shares: np.ndarray, recall: float
) -> float:
    """The least share with which the queue opens a leaf of the wanted part of all neighbours (``near``: per pilot row, unit vectors)."""
    needed = []
    for pilot, neighbours in zip(pilots, near):
        held = leaves_of(neighbours, planes, offsets)
        first = np.full(len(neighbours), np.inf)
        for tree, leaf, reached in _queue(pilot, planes, offsets, shares):
            first[(held[:, tree] == leaf) & (first > reached)] = reached
            if np.isfinite(first).all():
                break
        needed.extend(first.tolist())
    if not needed:
        return 2.0
    needed.sort()
    return float(np.nextafter(needed[max(0, int(np.ceil(recall * len(needed))) - 1)], 3.0))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1; cosines stay the same to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _nearest(pilots: np.ndarray, pilot_ids: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` rows of a partition with the largest cosines for each pilot row."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, list[float]]]] = [[] for _ in pilots]
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(1), np.float64, pilots.shape[1])
            cosines = pilots @ _unit(vectors).T
            cosines[pilot_ids[:, None] == ids[None, :]] = -np.inf
            for kept, row in zip(best, cosines):
                top = np.argpartition(-row, min(k, len(row)) - 1)[:k] if len(row) else []
                kept.extend((-float(row[i]), int(ids[i]), vectors[i].tolist()) for i in top if row[i] > -np.inf)
                kept.sort()
                del kept[k:]
        flat = [(q, -c, v, x) for q, kept in enumerate(best) for c, v, x in kept]
        columns = list(zip(*flat)) or [(), (), (), ()]
        types = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "score", "vec_id", "vec"])

    return nearest


def neighbours_of(rows: DataFrame, pilots: np.ndarray, pilot_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Unit vectors of the exact ``k`` neighbours of each pilot row (a unit vector), by one pass over ``rows`` (vec_id, vec)."""
    found = rows.mapInArrow(_nearest(pilots, pilot_ids, k), "query_id long, score double, vec_id long, vec array<double>")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near: list[list] = [[] for _ in pilots]
    for r in found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect():  # PILOT_ROWS * k rows
        near[r["query_id"]].append(r["vec"])
    return [_unit(np.array(v, np.float64).reshape(len(v), pilots.shape[1])) for v in near]


def _file(planes: np.ndarray, offsets: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = leaves_of(_unit(matrix(batch.column(1), np.float64, planes.shape[2])), planes, offsets)
            lists = pa.ListArray.from_arrays(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1], leaves.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "vec", "leaves"])

    return file


def _probe(planes, offsets, shares, wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(matrix(batch.column(1), np.float64, planes.shape[2]))
            opened = [probes_of(unit, planes, offsets, shares, wanted) for unit in units]
            trees = pa.array([[t for t, _ in o] for o in opened], pa.list_(pa.int32()))
            leaves = pa.array([[x for _, x in o] for o in opened], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, trees, leaves], ["vec_id", "vec", "trees", "leaves"])

    return probe


def _rerank(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def rerank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("vec_id")
            ids, vectors = rows["vec_id"].to_numpy(), matrix(rows["vec"], np.float64)
            asked = matrix(queries["vec"], np.float64)
            width = max(vectors.shape[1], asked.shape[1])
            vectors, asked = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, asked))
            vectors, asked = _scaled(vectors), _scaled(asked)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            # the product picks a few more than k; those are computed again, in one order of adding for all blocks
            rough = np.round((_unit(asked) @ (vectors / norms[:, None]).T), 12)
            for query_id, query, cosines in zip(queries["vec_id"].to_pylist(), asked, rough):
                cosines[ids == query_id] = -np.inf
                few = np.argsort(-cosines, kind="stable")[: k + 8]
                few = few[ids[few] != query_id]
                exact = (vectors[few] * query).sum(axis=1) / (norms[few] * np.sqrt((query * query).sum()))
                best = np.lexsort((ids[few], -exact))[:k]
                out[0].extend([query_id] * len(best))
                out[1].extend(ids[few][best].tolist())
                out[2].extend(exact[best].tolist())
        types = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], ["query_id", "vec_id", "score"])

    return rerank


def forest_neighbours(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    share: float | None = None,
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest rows by cosine that the forest finds for each query row, with their exact cosines.

    Queries are the rows whose id is divisible by ``every``. Rows with a null id, a null or all-zero vector, or null
    or non-finite components take no part; missing components of a shorter vector count as 0. Rows that repeat an id
    are separate candidates, of which each vector answers once; the smallest of them asks and none answers it. Equal
    cosines go to the smaller id. Where no more than k candidates are found, all of them are returned; with few rows
    the one leaf holds all of them. An empty table gives no rows. ``share`` says how large a share of the rows the
    opened leaves have to hold; without it, the share is measured so that ``recall`` of the neighbours of some rows are found.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).filter(F.exists("vec", lambda x: x != 0))
    count = rows.count()
    depth = max(0, min(MAX_DEPTH, int(count // leaf_rows).bit_length()))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec").limit(SAMPLE_ROWS).toArrow()
    width = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    units = _unit(matrix(sample["vec"], np.float64, width))
    planes, offsets = fit_forest(units, trees, depth)
    filed = stage(rows.mapInArrow(_file(planes, offsets), "vec_id long, vec array<double>, leaves array<int>"))
    whole = filed.select("vec_id", "vec")
    filed = filed.select("vec_id", F.col("vec"), F.posexplode("leaves").alias("tree", "leaf"))
    shares = np.zeros((trees, 2**depth))
    sizes = filed.groupBy("tree", "leaf").count().collect()  # one row per leaf, at most trees * 2**MAX_DEPTH
    for r in sizes:
        shares[r["tree"], r["leaf"]] = r["count"] / count
    if share is None:
        pilots = units[:PILOT_ROWS]
        near = neighbours_of(whole, pilots, sample["vec_id"].to_numpy()[:PILOT_ROWS], k)
        share = share_for(pilots, near, planes, offsets, shares, recall)
    parts = [(r["tree"], r["leaf"], -(-r["count"] // BLOCK_ROWS)) for r in sizes]
    asked = queries_of(rows, every).mapInArrow(
        _probe(planes, offsets, shares, share), "vec_id long, vec array<double>, trees array<int>, leaves array<int>"
    )
    asked = asked.select("vec_id", "vec", F.explode(F.arrays_zip("trees", "leaves")).alias("at")).select(
        "vec_id", "vec", F.col("at.trees").alias("tree"), F.col("at.leaves").alias("leaf")
    )

    def with_parts(df: DataFrame) -> DataFrame:
        small = spark.createDataFrame(parts, "tree int, leaf int, parts long")
        return df.join(F.broadcast(small), ["tree", "leaf"])

    asked = with_parts(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = with_parts(filed).withColumn("part", bucket("vec_id", F.col("parts")))
    key = ["tree", "leaf", "part"]
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_rerank(k), FOUND)
    return best_of_query(found.distinct(), k, "double")
