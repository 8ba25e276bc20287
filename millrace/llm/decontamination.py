"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

Texts are sets of shingles of five words. A benchmark item is contained in a
document if the document has `threshold` of the item's shingles, however long
the document is. A MinHash signature of a long document says next to nothing
about a short item within it: the two sets' resemblance is near 0. So the
sketch is taken of the item alone, and looked up among all the document's
hashes.

Items are partitioned by their number of shingles. One with q shingles, of
which ceil(threshold * q) are needed, is sketched by its q - needed + 1 least
hashes; a document that lacks all of them lacks too many, so no match is lost.
Each size class has the least number of shingles that its items need and a
bound, the largest hash in its sketches. A document takes part in the classes
that need no more shingles than it has, and looks up its hashes up to the
largest bound of these classes. One lookup serves all classes: a hash above a
class's bound is in none of its sketches, so that lookups of their own would
find the same and cost one more row for each class. Candidates are then
verified by the shingles themselves.

Documents are read once for the candidates, whatever lengths items have, and
once to verify. Sketches, candidates and the items' shingles are broadcast only
after their rows or bytes are counted and found below a bound; beyond it the
same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, bounded_bytes, checkpoint, free, row_key, table

SHINGLE = 5
THRESHOLD = 0.8


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    said = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, " "))


def each(words: Column, n: int, f) -> Column:
    """f(the n words of a shingle) for every shingle; words are evaluated once."""
    starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(words), lambda w: F.transform(starts(w), lambda i: f([F.get(w, i + k) for k in range(n)])))[0]


def hashes(words: Column, n: int) -> Column:
    return each(words, n, lambda w: F.xxhash64(*w))


def shingles(words: Column, n: int) -> Column:
    return F.array_distinct(each(words, n, lambda w: F.concat_ws(" ", *w)))


def sketches(items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each item with a word: _item (its number), item_id, n (words of its shingles), size, needed, class, sketch, shingles.

    An item of fewer words than a shingle is one shingle of all its words.
    """
    rows = items.select(F.col(item).alias("item_id"), words_of(text).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(shingle)))

    def by_n(f) -> Column:
        out = f(F.col("words"), shingle)
        for n in range(1, shingle):
            out = F.when(F.col("n") == n, f(F.col("words"), n)).otherwise(out)
        return out

    rows = rows.select("item_id", "n", F.array_sort(F.array_distinct(by_n(hashes))).alias("hashes"), by_n(shingles).alias("shingles"))
    rows = rows.withColumn("size", F.size("shingles")).withColumn("needed", F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    sketch = F.slice("hashes", 1, F.greatest(F.size("hashes") - F.col("needed") + 1, F.lit(1)))
    return rows.select(F.monotonically_increasing_id().alias("_item"), "item_id", "n", "size", "needed", F.floor(F.log2("size")).cast("int").alias("class"), sketch.alias("sketch"), "shingles")


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of a row of docs and an item it contains: _row, doc_id, item_id, n_shingles, n_shared, containment.

    Every pair that reaches the threshold is there, and no other. Items and
    documents without words (null, empty, signs only) are in no pair. Repeated
    rows, of either table, repeat their pairs. Null ids stay null. Columns of
    docs other than the two do not matter.
    """
    sketched = checkpoint(sketches(items, shingle, threshold))
    classes = sketched.groupBy("n", "class").agg(F.max(F.array_max("sketch")).alias("bound"), F.min("needed").alias("least")).collect()  # one row for each power of two of shingles
    rows = docs.select(row_key(docs, key, text).alias("_row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if not classes:
        return rows.select("_row", "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).where("false")
    lengths = sorted({c["n"] for c in classes})
    words = F.size("words")
    bound = F.greatest(*[F.when(words - c["n"] + 1 >= c["least"], c["bound"]) for c in classes], F.lit(-(1 << 63)))
    # Each place with the words from there on; the last ones lack some.
    places = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(words - k, F.lit(0))) for k in range(lengths[-1])])
    at = rows.select("_row", words_of("text").alias("words")).select("_row", words.alias("n_words"), bound.alias("bound"), F.explode(places).alias("z"))
    hash_of = lambda n: F.when(F.col("z")[str(n - 1)].isNotNull(), F.xxhash64(*[F.col("z")[str(k)] for k in range(n)]))
    # Hashes of runs of several lengths are looked up alike; should two be equal by chance, the pair is verified like any other.
    h = hash_of(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*[hash_of(n) for n in lengths]))
    hashed = at.select("_row", "n_words", "bound", h.alias("h")).where("h <= bound").drop("bound")
    lookup = bounded(checkpoint(sketched.select("_item", "n", "needed", F.explode("sketch").alias("h"))))
    candidates = checkpoint(hashed.join(lookup, "h").where("n_words - n + 1 >= needed").select("_row", "_item").distinct())
    whole = sketched.select("_item", "item_id", "n", "size", "needed", "shingles")
    whole = bounded_bytes(whole, F.aggregate("shingles", F.lit(64).cast("long"), lambda s, x: s + F.octet_length(x) + 16))
    chosen = rows.join(bounded(candidates), "_row").withColumn("words", words_of("text")).join(whole, "_item")
    mine = shingles(F.col("words"), lengths[-1])
    for n in lengths[:-1]:
        mine = F.when(F.col("n") == n, shingles(F.col("words"), n)).otherwise(mine)
    shared = F.size(F.array_intersect(mine, F.col("shingles")))
    verified = chosen.withColumn("n_shared", shared).where("n_shared >= needed")
    return verified.select("_row", "doc_id", "item_id", F.col("size").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("size")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with the columns of docs.

    Rows without words (null, empty, signs only) stay, as do all rows where no
    item has a word. Of rows that repeat key and text all go or all stay.
    """
    row = free(docs, "row")
    dirty = bounded(checkpoint(contained(docs, items, shingle, threshold, key, text).select(F.col("_row").alias(row)).distinct()))
    return docs.withColumn(row, row_key(docs, key, text)).join(dirty, row, "left_anti").drop(row)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


ORACLE = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
item_words AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
item_shingles AS (SELECT DISTINCT i, item_id, least(len(w), 5) AS n, unnest([array_to_string(w[k : k + least(len(w), 5) - 1], ' ') for k in range(1, len(w) - least(len(w), 5) + 2)]) AS s FROM item_words WHERE len(w) > 0),
sizes AS (SELECT i, count(*) AS q FROM item_shingles GROUP BY i),
lengths AS (SELECT DISTINCT n FROM item_shingles),
doc_shingles AS (SELECT DISTINCT r, doc_id, n, unnest([array_to_string(w[k : k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) AS s FROM words, lengths WHERE len(w) >= n)
SELECT doc_id, item_id, CAST(q AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, round(count(*) / q, 6) AS containment
FROM doc_shingles JOIN item_shingles USING (n, s) JOIN sizes USING (i)
GROUP BY r, doc_id, i, item_id, q HAVING count(*) >= ceil(0.8 * q - 1e-9)
"""

QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES = {"op4_decontamination": ORACLE}
