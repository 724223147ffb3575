"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import shared_dir


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.passages import repeated_passages

    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.wavelet import read_documents, write_shards

    path = f"{shared_dir(spark)}/countloom/shards-{uuid.uuid4().hex}"
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, end_id=1)
    return read_documents(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.toxicity import fold, score, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=2048, end_id=0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.licenses import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].drop("row")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, radius=2)


def op7_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.avi import store_texts

    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.bpe_table import encode_decode

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.pitman_yor import score_documents

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.vptree import neighbours

    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.chat_format import format_conversations

    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return format_conversations(given.unionByName(more))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.filter_audit import audit

    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.llm.conversation_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compact_windows": op1_compact_windows,
        "op2_wavelet_shards": op2_wavelet_shards,
        "op3_toxicity": op3_toxicity,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_license_scan": op5_license_scan,
        "op6_simhash": op6_simhash,
        "op7_motion_jpeg": op7_motion_jpeg,
        "op8_word_table_bpe": op8_word_table_bpe,
        "op9_pitman_yor": op9_pitman_yor,
        "op10_vantage_point_trees": op10_vantage_point_trees,
        "op11_chat_format": op11_chat_format,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    from countloom.llm import chat_format, conversation_trie, filter_audit, licenses

    return {
        "op5_license_scan": licenses.oracle_sql(),
        "op11_chat_format": chat_format.oracle_sql(),
        "op12_filter_audit": filter_audit.oracle_sql(),
        "op13_conversation_trie": conversation_trie.oracle_sql(),
    }
