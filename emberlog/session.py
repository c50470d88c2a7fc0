"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects may repeat a key; the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Rows a driver-side table may have before it is kept on the cluster instead.
DRIVER_ROW_BOUND = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session somebody else built."""
    for key, value in SESSION_CONFS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` when the cluster names one.

    A temporary folder is used only where nothing is set and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="emberlog-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def materialise_small(df: DataFrame, bound: int = DRIVER_ROW_BOUND) -> DataFrame:
    """Evaluate a table once: as a local relation when it is small, as a checkpoint when not.

    A local relation has a known size, so joins with it are planned on facts.
    """
    rows = df.limit(bound + 1).toArrow()
    if rows.num_rows <= bound:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return cut_lineage(df)


def small_side(df: DataFrame, bound: int = DRIVER_ROW_BOUND) -> DataFrame:
    """Mark an evaluated table as the broadcast side if it has at most ``bound`` rows, else for merging."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df.hint("merge")


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps read the same intermediate rows: the table survives lost
    executors, keeps its row order per file and lets later scans prune columns. It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where a table is dealt out before costly work on each row.
SPREAD_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table of files before costly work: a table of many rows always, a small one read from few splits.

    Splits of a file may hold no row group, so their number does not tell how many tasks have rows.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    tasks = slots * -(-df.count() // (SPREAD_ROWS * slots))  # parquet counts by its footers
    if tasks > slots:
        return df.repartition(tasks)
    return df.repartition(slots) if df.rdd.getNumPartitions() * 2 <= slots else df
