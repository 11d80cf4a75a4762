"""From raw documents to packed sequences: five stages, each by one operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and the next stage reads that. All but the last return the columns of
``documents``. SQL cannot express the language and near-duplicate stages, so there is no twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import langid, packing, quality, simhash, spans
from shelfwise.llm.common import WORD_CLASS, words_of, work_path

#: A text is rejected that no learnt language fits better than this.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language: letters, and a score of LEAST_SCORE or more."""
    rows = langid.identify(docs)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return rows.where(sure).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules, with thresholds of the rows at hand."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near copies: the least id, then the least text hash.

    Three-word shingles and two bits, the contract of op2. A document is an id with a text, so different
    texts of one id, or without an id, are told apart and group by their fingerprints alone; those without an
    id come last. Of rows equal in both the least by the other columns stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"))
    grouped = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    firsts = grouped.select("component_id.*").distinct().toDF("_unnamed", "_id", "_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(firsts, same, "left_semi")
    one = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]
    repeated = kept.groupBy(*one).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    single = kept.join(repeated, same, "left_anti")
    chosen = kept.join(repeated, same, "left_semi").groupBy("doc_id", "text").agg(
        F.min(F.struct(F.lit(0).alias("none"), *rest)).alias("row")
    )
    return single.unionByName(chosen.select("doc_id", "text", *[f"row.{c}" for c in rest]))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated sentence spans; documents of which no word is left go."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = spans.dedup_spans(docs.select("doc_id", "text", *rest), carry=rest)
    sized = left.withColumn("n_chars", F.length("text").cast("bigint"))
    return sized.where(F.col("text").rlike(WORD_CLASS)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins by their number of words."""
    return packing.pack(docs.select("doc_id", F.size(words_of(F.col("text"))).alias("n_tokens")))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
