"""Small helpers that several operators share."""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.shared import dropped, kept, shared_dir, stored  # noqa: F401


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and outlives any executor."""
    return kept(df, name)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once the driver has let go of their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str, text_col: str, fill: bool = True) -> DataFrame:
    """Two columns, ``doc_id`` and ``text``, whatever else the table has; a null text is empty if ``fill``."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if fill else text).alias("text"))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows to Python at a time: for rows that may hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A table of ids of so many rows (16 bytes each) may be broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 2_000_000


def sized(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``small``, to be broadcast in a join if a count finds it small enough, else as it is."""
    return F.broadcast(small) if small.count() <= most else small


#: A key of more than this share of all rows is joined by broadcast; of such keys there are fewer than its inverse.
HOT_SHARE = 1 / 1024


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique and stand in ``weight`` of the ``total`` rows: no key is hot in a
    shuffle, since the frequent ones are broadcast. Both tables are read twice."""
    most = int(total * HOT_SHARE)
    hot, rest = table.where(F.col(weight) > most), table.where(F.col(weight) <= most)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return near.unionByName(far)


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after the other, and where each begins (one place more than values); null: none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset or column.null_count:
        column = pa.concat_arrays([column, column[:0]])
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int32, len(column) + 1).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values are runs of ``data``, with so many bytes each."""
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.ascontiguousarray(data).reshape(-1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(data)])
