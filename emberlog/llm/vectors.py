"""What the two vector searches share: usable rows, queries, packed blocks, and merging of block results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``vec_id, vec`` (array of doubles) with an id and without null, NaN or infinite components."""
    vec = F.col(vector_col).cast("array<double>")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~odd)


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """One row per id divisible by ``every``; of rows that repeat an id the smallest vector asks."""
    return rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(vectors: pa.ChunkedArray | pa.Array, dtype: type, width: int = 0) -> np.ndarray:
    """Rows of numbers as a matrix; shorter vectors are filled with zeros up to the longest or ``width``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def best_of_query(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The ``k`` highest scores of each query over all blocks, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type))


def bucket(column: str, count: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), count if isinstance(count, Column) else F.lit(count))
