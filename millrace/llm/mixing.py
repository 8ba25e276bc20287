"""Operator 6: mixing sources to target weights.

Words are summed per source, each source's target gives its repetition rate,
and a document goes in floor(rate) times, plus once more if a number drawn from
its key is below the rate's fraction.

The words are counted once and kept as a slim checkpoint. Per-source sums are
partial aggregates before the shuffle, so a source with a third of all rows is
one row per task there. The table of rates goes back by broadcast only up to a
counted number of sources; beyond that the join shuffles, where Spark splits a
source too large for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, free, key_text, table, uniform

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST = 3
#: Up to this number of sources, their rates are broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size → also target: shares by weight of all sizes, none above `most` times its own size.

    Sources take the weights in code-point order, null last. If L is the level
    at which sum(min(most * size, L * weight)) is the total, a source's target
    is min(most * size, L * weight); sharing the excess again and again ends
    there. A source without words has the target 0. One row per source takes
    part, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sized = sources.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", weigh)
    sized = sized.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    # Sources are full in the order of cap / weight. With the first k full, the others stand at the level (total - their caps) / other weights.
    filling = Window.orderBy("fills_at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("fills_at", "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    sized = sized.withColumn("full", F.coalesce(F.sum("cap").over(filling), zero)).withColumn("taken_w", F.coalesce(F.sum("weight").over(filling), zero))
    level = (F.sum("source_size").over(every) - F.col("full")) / (F.sum("weight").over(every) - F.col("taken_w"))
    sized = sized.withColumn("level", level)
    stands = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "nth", "level"))).over(every)["level"]
    return sized.select("source", "source_size", F.least(F.col("cap"), F.coalesce(stands * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each row of docs as doc_id, source, size, source_size, target, rate, copies, taken; one row for each row.

    Empty and null texts have no words; their source may take copies of them,
    which add none. A null source is a source, a null key a key. Rows with the
    same key and text draw the same number. Column names of docs other than
    the three do not matter. An empty table gives no rows.
    """
    slim = checkpoint(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), uniform(F.lit(str(seed)), key_text(key), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("drawn")))
    sums = checkpoint(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    rates = sums.withColumnRenamed("source", "of").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = F.broadcast(rates) if sums.count() <= BROADCAST_SOURCES else rates
    copies = F.floor("rate") + (F.col("drawn") < F.col("rate") - F.floor("rate")).cast("long")
    mixed = slim.join(rates, slim["source"].eqNullSafe(rates["of"])).withColumn("copies", copies.cast("long"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "drawn")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as its copies say, with the columns of docs.

    The same hash decides as in mix(); the rates come from it.
    """
    key, text, source, seed = (options.get(k, v) for k, v in (("key", "doc_id"), ("text", "text"), ("source", "source"), ("seed", 7)))
    sums = checkpoint(targets(docs.select(F.col(source).alias("source"), n_words(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), options.get("weights", WEIGHTS), options.get("most", MOST)))
    of, rate = free(docs, "of"), free(docs, "rate")
    rates = sums.select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    rates = F.broadcast(rates) if sums.count() <= BROADCAST_SOURCES else rates
    drawn = uniform(F.lit(str(seed)), key_text(docs[key]), F.md5(F.coalesce(docs[text], F.lit(""))))
    copies = (F.floor(rate) + (drawn < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    rows = docs.join(rates, docs[source].eqNullSafe(rates[of]))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(of)).drop(of)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS drawn
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM sums),
caps AS (SELECT *, [5.0, 2.0, 1.0][nth % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM weighed),
levels AS (
  SELECT a.nth, a.cap / a.weight AS fills_at,
    ((SELECT sum(source_size) FROM caps) - coalesce((SELECT sum(b.cap) FROM caps b WHERE (b.cap / b.weight, b.nth) < (a.cap / a.weight, a.nth)), 0))
    / ((SELECT sum(weight) FROM caps) - coalesce((SELECT sum(b.weight) FROM caps b WHERE (b.cap / b.weight, b.nth) < (a.cap / a.weight, a.nth)), 0)) AS level
  FROM caps a),
stands AS (SELECT level FROM levels WHERE level <= fills_at ORDER BY fills_at, nth LIMIT 1),
rates AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM stands) * weight, cap)) AS target FROM caps)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) + CAST(drawn < target / source_size - floor(target / source_size) AS BIGINT) ELSE 0 END * size AS BIGINT) AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": ORACLE}
