"""Leakage control: copies, splits that meet, and denylists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T
from ..sources.tables import checkpoint

#: Rows of a denylist that may be broadcast.
BROADCAST_ROWS = 200_000


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """key, n: the values that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def owners(df: DataFrame, key: str, row: str, order: str) -> DataFrame:
    """row, owner: for each row that repeats a key, the first row (by `order`) that has it.

    A key's rows are merged to their first before they are joined back, so a
    key that many rows share is one row on that side.
    """
    df = checkpoint(df.select(key, row, *([order] if order != row else [])))  # keys are often digests of texts, made once
    # Kept apart from the join, so that Spark can split a key that very many rows share over several tasks there.
    first = checkpoint(df.groupBy(key).agg(F.min_by(row, order).alias("owner"), F.count("*").alias("n")).where("n > 1").select(key, "owner"))
    return df.select(key, row).join(first, key).where(F.col(row) != F.col("owner")).select(row, "owner")


def split_overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """left, right, n: keys that two splits share, by pair of splits.

    One aggregate gives the splits of each key; their number is that of the
    split names, so the pairs within a key are few.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
    pairs = sets.select(F.explode("splits").alias("left"), "splits").select("left", F.explode("splits").alias("right")).where("left < right")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count finds it small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Characters in a row by which items of few words are looked up; fewer if an item has fewer.
CHARACTERS = 8


def _runs(units: Column, n: int, skip: int = 0) -> Column:
    """Hashes of each n units (words or characters) in a row, without the first and last `skip` units."""
    last = F.size(units) - n - skip
    starts = F.when(last >= skip, F.sequence(F.lit(skip), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(units), lambda w: F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])))[0]


#: Bytes of the items' texts, and 16 an item, that one automaton may hold; its nodes take some 60 times as much.
AUTOMATON_BYTES = 4 << 20


#: The automaton last made in a worker, by its broadcast's number.
_made: dict[int, object] = {}


def _automaton(number: int, texts: Broadcast):
    """The automaton of a broadcast's texts, made once in a worker: each text leads to its places in the list."""
    import ahocorasick

    if number not in _made:
        of: dict[str, list[int]] = {}
        for i, said in enumerate(texts.value):
            of.setdefault(said, []).append(i)
        made = ahocorasick.Automaton()
        for said, places in of.items():
            made.add_word(said, places)
        made.make_automaton()
        _made.clear()
        _made[number] = made
    return _made[number]


def _finder(number: int, texts: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (doc, text): doc and the number of each text that the document's holds, once a row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(number, texts)
        for b in batches:
            rows, places = [], []
            for r, said in enumerate(b.column(1)):
                held = {i for _, some in automaton.iter(said.as_py()) for i in some}
                rows += [r] * len(held)
                places += held
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], names=[b.schema.names[0], "_i"])

    return find


def containing(docs: DataFrame, denied: DataFrame, doc: str, item: str, text: str = "text", n: int = 3, automaton: int = AUTOMATON_BYTES) -> DataFrame:
    """Pairs (doc, item) where the document's text contains the item's text, anywhere; null and empty texts are in no pair.

    Items of no more than `automaton` bytes together go to every worker as one
    automaton, which finds all of them in one pass over each text: documents are
    not shuffled, only pairs are. Items beyond that are joined by runs of words.
    """
    items = denied.where(F.length(text) > 0).select(item, text)
    size = items.agg(F.sum(F.octet_length(text).cast("long") + 16)).first()[0] or 0
    if size > automaton:
        return _containing_by_runs(docs, denied, doc, item, text, n)
    held = items.collect()  # of that many bytes at most
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast([r[1] for r in held])
    of = t.StructType([t.StructField("_i", t.LongType()), t.StructField(item, denied.schema[item].dataType)])
    names = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(held)], of))
    pairs = t.StructType([t.StructField(doc, docs.schema[doc].dataType), t.StructField("_i", t.LongType())])
    met = docs.where(F.length(text) > 0).select(doc, text)
    if not held:
        return met.select(doc, F.lit(None).cast(denied.schema[item].dataType).alias(item)).where("false")
    return met.mapInArrow(_finder(kept._jbroadcast.id(), kept), pairs).join(names, "_i").select(doc, item).distinct()


def _containing_by_runs(docs: DataFrame, denied: DataFrame, doc: str, item: str, text: str, n: int) -> DataFrame:
    """containing() by joins alone.

    A substring of n + 2 or more blank-separated words has its inner words
    whole, so the least hash of n inner words in a row is looked up among the
    document's. An item of fewer words is looked up by the least hash of its
    runs of CHARACTERS characters, one of fewer characters by all of it. What is
    found is compared; only then do texts take part.
    """
    words, letters = F.split(text, " "), F.split(text, "")
    items = denied.where(F.length(text) > 0).select(F.col(item), F.col(text).alias("_wanted"), words.alias("_words"), letters.alias("_letters"))
    kind = F.when(F.size("_words") >= n + 2, 0).otherwise(F.least(F.size("_letters"), F.lit(CHARACTERS)))
    least = F.when(F.col("_kind") == 0, F.array_min(_runs(F.col("_words"), n, 1)))
    for k in range(1, CHARACTERS + 1):
        least = least.when(F.col("_kind") == k, F.array_min(_runs(F.col("_letters"), k)))
    items = checkpoint(items.withColumn("_kind", kind).select(item, "_wanted", "_kind", least.alias("_h")))
    kinds = [r[0] for r in items.select("_kind").distinct().collect()]  # nine at most
    if not kinds:
        return docs.select(doc, F.lit(None).cast(denied.schema[item].dataType).alias(item)).where("false")
    every = F.concat(*[_runs(F.col("_words"), n) if k == 0 else _runs(F.col("_letters"), k) for k in kinds])
    keyed = docs.select(doc, words.alias("_words"), letters.alias("_letters")).select(doc, F.explode(F.array_distinct(every)).alias("_h"))
    met = checkpoint(keyed.join(bounded(items.select(item, "_h")), "_h").select(doc, item).distinct())
    both = docs.select(doc, text).join(bounded(met), doc).join(items.select(item, "_wanted"), item)
    return both.where(F.col(text).contains(F.col("_wanted"))).select(doc, item).distinct()


def denied_leaves(leaves: DataFrame, exact: DataFrame, normalized: DataFrame, least_length: int) -> DataFrame:
    """The leaves (row, value, protected) whose digest, as they are or normalized, a denylist has: row, value, how.

    exact and normalized have a column digest; normalized texts are case-folded
    and have single spaces.
    """
    long = leaves.where(F.col("protected") & (F.length(F.trim("value")) >= least_length))
    by = lambda c, deny, how: long.withColumn("digest", c).join(bounded(deny.select("digest").distinct()), "digest", "left_semi").select("row", "value", F.lit(how).alias("how"))
    return by(T.sha256(F.col("value")), exact, "exact").union(by(T.folded_fingerprint(F.col("value")), normalized, "normalized"))
