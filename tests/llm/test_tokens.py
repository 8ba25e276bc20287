import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import tokens
from millrace.llm.common import fresh_path

from .fixtures import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_and_cache(spark):
    cache = fresh_path(spark, "cache-test")
    rows = [*documents(), (30, "a<|endoftext|>b", "en", "a", 0), (31, "日本語 \U0001f600", "en", "a", 0)]
    t = Tokenizer.from_file(PATH)
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = sorted(str((i, len((x or "").encode()), n(x), n(x) > 1024)) for i, x, *_ in rows)
    docs = frame(spark, rows).withColumn("n_tokens", F.lit(1)).withColumn("content", F.lit("x"))
    assert sorted(str(tuple(r)) for r in tokens.count_tokens(docs, PATH, cache).collect()) == want
    assert n("a<|endoftext|>b") == 3
    # What is stored is used, and only what is missing is added.
    distinct = len({x or "" for _, x, *_ in rows})
    assert spark.read.parquet(cache).count() == distinct
    more = [*rows, (40, "new text", "en", "a", 0), (41, "new text", "en", "a", 0)]
    assert tokens.count_tokens(frame(spark, more), PATH, cache).count() == len(more)
    assert spark.read.parquet(cache).count() == distinct + 1
    # Another tokenizer has entries of its own.
    other = tokens.count_tokens(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert other.where("doc_id = 8").first()["n_tokens"] == 2
    assert spark.read.parquet(cache).count() == 2 * distinct + 1


def test_entries_that_are_there_twice_count_once(spark):
    cache = fresh_path(spark, "cache-test")
    docs = frame(spark, [(1, "x y", "en", "a", 0)])
    tokens.fill(docs, PATH, cache)
    spark.read.parquet(cache).coalesce(1).write.mode("append").parquet(cache)
    assert tokens.count_tokens(docs, PATH, cache).count() == 1


def test_empty_table(spark):
    assert tokens.count_tokens(frame(spark, []), PATH, fresh_path(spark, "cache-test")).count() == 0
