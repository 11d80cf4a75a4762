"""Token counts through a cache of content digests.

A text's key is the SHA-256 of its normalised content together with the SHA-256 of the
tokenizer's vocabulary file. Documents are joined to the cached counts by key; only one
text of each key that is missing is encoded, and its count is appended to the cache.

Normalising may join only texts of equal count: for a vocabulary that drops white space,
runs of ASCII white space become one space and the ends are trimmed; otherwise the text
stays as it is. Null texts count as empty; extra columns are ignored; repeated rows, also of
one id, each get their count. An empty table gives an empty result and leaves the cache be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CLASS, ship, work_path
from shelfwise.llm.tokens import encoder, slices, splits_on_space, version_digest

CACHE = "content binary, tokenizer string, n_tokens bigint"


def text_counts(texts: list[bytes], vocabulary: str) -> list[int]:
    """The token count of each text as the vocabulary's library gives it."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        from shelfwise.llm.tokens import vocabulary_path

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        return [len(x) for x in pieces.encode([t.decode() for t in texts], num_threads=1)]
    own = encoder(vocabulary)
    if not splits_on_space(vocabulary):
        return [len(own.library.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
    counts = []
    for a, b in slices(texts):
        split = [t.split() for t in texts[a:b]]
        table = own.table(set().union(*split))
        sizes = {word: len(ids) >> 2 for word, ids in table.items()}
        counts += [sum(map(sizes.__getitem__, words)) for words in split]
    return counts


def token_counts(
    docs: DataFrame,
    cache_path: str | None = None,
    vocabulary: str = "word_bpe_49k.json",
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; new counts are appended to the cache.

    ``cache_path`` is a Parquet folder, by default a new one. A run that is repeated finds
    the counts of the first and encodes nothing. Two runs at once may append the same key
    twice; readers take one.
    """
    spark = docs.sparkSession
    ship(spark)
    cache_path = cache_path or work_path(spark, "token_cache")
    version = version_digest(vocabulary)
    body = F.coalesce(F.col(text_col), F.lit(""))
    if splits_on_space(vocabulary):
        body = F.trim(F.regexp_replace(body, f"{SPACE_CLASS}+", " "))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("content"),
    )
    texts = docs.select(body.alias("body")).select(
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("content"), "body"
    )
    missing = texts.join(stored(spark, cache_path, version), "content", "left_anti")
    distinct = missing.groupBy("content").agg(F.first("body").alias("body"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").cast(pa.binary()).to_pylist()
            counts = text_counts(bodies, vocabulary)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("content"),
                    pa.array([version] * len(counts), pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                names=["content", "tokenizer", "n_tokens"],
            )

    distinct.mapInArrow(per_batch, CACHE).write.mode("append").parquet(cache_path)
    counted = keyed.join(stored(spark, cache_path, version), "content")
    return counted.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(content, n_tokens): the cached counts of one tokenizer version, one row a content."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    cache = spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)
    rows = cache.where(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
