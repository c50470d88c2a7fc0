"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import shared_dir

#: Words are maximal runs of bytes outside this set, the white space of ``bytes.split()``.
ASCII_SPACE = " \t\n\r\x0b\x0c"


#: Setting that bounds the bytes of the Arrow batches sent to Python, whatever the length of the texts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the folder goes when the driver ends.

    Later steps then start from files that outlive lost executors, and prune columns of them. ``batch_bytes`` bounds
    the Arrow batches of this one write; the caller's setting stays as it was.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_BYTES, None)
    if batch_bytes:
        spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        if batch_bytes:
            spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)
    forget_at_exit(spark, where)
    # shuffle files are deleted once the driver's collector finds them unused; asking now keeps one step's at a time
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(where)


def forget_at_exit(spark: SparkSession, where: str) -> None:
    """Have a staged folder removed when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_null(docs: DataFrame, text_col: str = "text") -> Column:
    return F.col(text_col).cast("string")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: Column, divisor: int) -> Column:
    """Fold of a row: crc32 of the id written as text, modulo ``divisor``."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def thinned(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 22) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted ones: all that are, and few others.

    A bitmap over hashes of the wanted keys is broadcast, at most ``2**bits / 8`` bytes whatever the tables' sizes; it
    keeps most rows that a later join would drop from being shuffled. With very many wanted keys it lets all pass.
    """
    size, bucket_bits = 1 << bits, 32_768
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(size)) + 1
    marks = (
        wanted.select(slot(wanted_key).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    place = F.col("_place")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("_slot", slot(key)).withColumns(
        {"_bucket": F.bitmap_bucket_number("_slot"), "_place": F.bitmap_bit_position("_slot")}
    )
    hit = marked.join(F.broadcast(marks), "_bucket").filter(F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1)
    return hit.drop("_slot", "_bucket", "_place", "_bits")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of undirected links: ``node``, and ``component``, the smallest node within reach.

    Every round takes the least label among a node and its neighbours and then the label of that label, so that rounds
    grow with the logarithm of the longest path about; each round's labels are written and read again.
    """
    links = links.select(F.col(left).alias("_a"), F.col(right).alias("_b"))
    links = stage(links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    nearest = links.groupBy("_a").agg(F.min("_b").alias("nearest"))
    labels = stage(nearest.select(F.col("_a").alias("node"), F.least("_a", "nearest").alias("component")))
    while True:
        nearest = (
            links.join(labels, links["_b"] == labels["node"])
            .groupBy(F.col("_a").alias("node"))
            .agg(F.min("component").alias("nearest"))
        )
        lower = labels.join(nearest, "node").select(
            "node", F.least("component", "nearest").alias("component"), F.col("component").alias("before")
        )
        above = lower.select(F.col("node").alias("_up"), F.col("component").alias("_further"))
        lower = stage(
            lower.join(above, F.col("component") == F.col("_up")).select(
                "node", F.least("component", "_further").alias("component"), "before"
            )
        )
        labels = lower.select("node", "component")
        if lower.filter("component <> before").isEmpty():
            return labels
