"""Operator 8: token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by that
of its file. Counts are kept under both in a Parquet table; only content that
the table lacks is encoded, once however many rows have it, and appended.

Texts are shuffled once, to meet their copies; rows that repeat a text are
merged before the shuffle. Batches of bounded size go through the encoder.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, delete_path, fresh_path, small_batches, table

LIMIT = 1024
#: Characters given to the encoder at a time, but for a single longer text.
CHUNK = 1 << 18
CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to token counts, as the file's own library counts them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in p.encode(texts, num_threads=1)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: str | Column) -> Column:
    """What decides a count: the text itself, null as empty. Anything more could change counts."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty where there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def fill(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> None:
    """Encode what the cache lacks of docs and append it there."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for b in batches:
            texts, counts, start, size = b.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK or i == len(texts) - 1:
                    counts += count(texts[start : i + 1])
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    content = docs.select(F.sha2(normalised(text), 256).alias("content_digest"), normalised(text).alias("content"))
    known = cached(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest")
    # Copies are merged where they are read, before anything is shuffled.
    distinct = content.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known, "content_digest", "left_anti")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    A null or empty text has no tokens. Repeated rows and equal texts have one
    entry in the cache. An empty table gives no rows. A failed run leaves at
    most counts in the cache that are right; should one text be appended twice
    by two runs at a time, both entries say the same and count as one.
    """
    fill(docs, tokenizer, cache, text)
    known = cached(docs.sparkSession, cache).where(F.col("tokenizer_digest") == tokenizer_digest(tokenizer))
    # Kept apart from the join, so that Spark can split a text with very many copies over several tasks there.
    known = checkpoint(known.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(normalised(text), 256).alias("content_digest"), F.octet_length(normalised(text)).cast("long").alias("n_bytes"))
    return rows.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a fresh one in the shared folder, and goes when the counts are taken: every run encodes all distinct texts."""
    import public_tokenizers

    cache = fresh_path(spark, "token-cache")
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    delete_path(spark, cache)  # what is read of it stands in a checkpoint
    return counted


QUERIES = {"op8_tokens": op8_tokens}
ORACLES: dict[str, str] = {}
