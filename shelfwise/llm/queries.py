"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bm25,
    chunk_encode,
    conversations,
    digest_cache,
    histogram_packing,
    langid,
    materialise,
    packing,
    quality,
    simhash,
    spans,
    whitening,
    wrapper,
)
from shelfwise.llm.common import words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every document by its number of words."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", F.size(words_of(F.col("text"))).alias("n_tokens")))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under SimHash links of 2 bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op4_chunk_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    docs = _table(spark, sf_dir, "documents")
    coded = chunk_encode.encode_documents(docs, digests_only=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.OWN)


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50."""
    docs = _table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 50 == 0).select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")
    )
    return bm25.search(docs, asked)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier span."""
    return spans.dedup_spans(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, file and offset of every sequence of the training-order files it writes."""
    return materialise.sequence_slots(_table(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document through a new digest cache."""
    return digest_cache.token_counts(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return histogram_packing.pack_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    own = (
        op1_best_fit_packing,
        op2_simhash_near_duplicates,
        op3_main_text,
        op4_chunk_encode,
        op5_quality_rules,
        op6_bm25_search,
        op7_sentence_spans,
        op8_language,
        op9_training_order,
        op10_token_counts,
        op11_whitening,
        op12_conversation_repair,
        op13_packing,
    )
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    """The twins of the queries that SQL can express."""
    return {"op5_quality_rules": quality.TWIN, "op6_bm25_search": bm25.TWIN}
