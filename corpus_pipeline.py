"""A corpus pipeline: toxic documents go, of near duplicates one stays, repeated passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which a run writes as Parquet and reads again for the
next. All but the last return the columns of ``documents``. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import written
from countloom.llm.packing import pack_documents
from countloom.llm.passages import remove_passages, repeated_passages
from countloom.llm.simhash import near_copies, one_of_each
from countloom.llm.toxicity import clean_documents, train


#: So many rows go to Python at a time in every stage, since each may hold a long text.
BATCH = 1000


def in_small_batches(stage):
    """The stage, with the session's Arrow batches held to ``BATCH`` rows, also when its result is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # Still in force when the caller writes the result; a lower setting stays.
        held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH, held) if held > 0 else BATCH))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return clean_documents(docs, train(docs, labels), threshold=0.5)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays: fingerprints linked within two bits, or a
    common key of min-hashes, and then a similarity of 0.8 or more on five-word shingles."""
    return one_of_each(docs, near_copies(docs, width=5, similar=0.8, radius=2))


@in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of 50 words or more that an earlier document has too is cut; n_chars follows the text."""
    kept = remove_passages(docs, repeated_passages(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences of at most 2048."""
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL can't express a trained score, fingerprints, passages or packing; the tests check each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
