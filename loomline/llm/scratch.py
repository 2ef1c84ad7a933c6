"""Intermediate tables in the folder that all executors share, and names that clash with none."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts that a Python worker holds at once; the session's limit on a batch's bytes holds beside it.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Set the session's rows per Arrow batch to BATCH_ROWS, unless the session sets them itself. The plan alone changes by it: a
    batch is held in the executor, in its worker and once more as Python strings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, or the checkpoint folder set on its context. Where neither is, a temporary folder that
    the application keeps, on one machine only: a core setting can't be changed in a running session, so it is set on the context."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomline-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomline/{uuid.uuid4().hex}/{name}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once as Parquet to the shared folder and read back: a lost executor costs no recomputation, and every
    later use reads the same rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    pinned = spark.read.schema(df.schema).parquet(path)
    pinned.pinned_at = path
    return pinned


def release(*pinned: DataFrame) -> None:
    """Delete tables that `pin` made and no later job reads."""
    for df in pinned:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.pinned_at).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many `_` after it as keep it apart from `df`'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
