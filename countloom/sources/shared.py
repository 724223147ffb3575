"""Tables in the folder that all executors share: they cut lineage and outlive any executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set in the context. Where both are unset, a local session (tests)
    gets one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="countloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows to Python at a time: for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> str:
    """Writes ``df`` as a Parquet table to the shared folder; its path."""
    path = os.path.join(shared_dir(df.sparkSession), "countloom", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
