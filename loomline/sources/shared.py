"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, or the checkpoint folder of its context. Where neither is set, a temporary one that the context then
    has, on one machine only."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomline-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder in it."""
    return f"{shared_base(spark)}/run-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, its partitions kept as they are: what names them stays true in every later job, on any executor."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of a URI or a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "/", path))
