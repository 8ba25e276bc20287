"""Digests of ordered tables as hash trees: roots, proofs that a row is in, and where two tables differ.

Leaves are numbered by ranges of their order, so sparse keys of any kind make
no sparse nodes. A node is the digest of up to `fan` digests below it: no value
is built of more than that, and a table of n rows has log n levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint, numbered

FAN = 16


def leaf(text: Column) -> Column:
    """The digest of a row's text; null is a value of its own. No node has the digest of a leaf."""
    return F.sha2(F.concat(F.when(text.isNull(), F.lit("n")).otherwise(F.lit("l")), F.coalesce(text, F.lit(""))), 256)


def _node(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """The digests of nodes from rows (i, digest) of their children, at most `fan` of them."""
    below = F.array_sort(F.collect_list(F.struct("i", "digest")))
    return rows.groupBy(*keys).agg(F.sha2(F.concat(F.lit("b"), F.array_join(F.transform(below, lambda x: x["digest"]), "")), 256).alias("digest"))


def tree(df: DataFrame, text: Column, *order: str, fan: int = FAN) -> DataFrame:
    """level, i, digest: level 0 has a leaf for each row, numbered from 0 in the order, ties by digest; the top level has the root.

    No rows give no tree.
    """
    rows = df.select(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], leaf(text).alias("digest"))
    level = checkpoint(numbered(rows, "i", *[f"o{n}" for n in range(len(order))], "digest").select((F.col("i") - 1).alias("i"), "digest"))
    n, at = level.count(), 0
    whole = level.select(F.lit(0).alias("level"), "i", "digest")
    while n > 1:
        n, at = -(-n // fan), at + 1
        level = checkpoint(_node(level, [F.floor(F.col("i") / fan).alias("up")]).select(F.col("up").alias("i"), "digest"))
        whole = whole.union(level.select(F.lit(at).alias("level"), "i", "digest"))
    return whole


def root(nodes: DataFrame) -> DataFrame:
    """The row of a tree's root."""
    return nodes.orderBy(F.col("level").desc()).limit(1)


def proofs(nodes: DataFrame, places: DataFrame, fan: int = FAN) -> DataFrame:
    """place, level, i, digest: for each leaf named in places (place), the nodes beside it and beside those above it, its own left out."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    up = F.lit(1).cast("long")
    ways = []
    for k in range(top):
        ways.append(F.struct(F.lit(k).alias("level"), F.floor(F.col("place") / (up * fan**k)).alias("own"), F.floor(F.col("place") / (up * fan ** (k + 1))).alias("up")))
    if not ways:
        return places.select("place").where("false").select("place", F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), F.lit("").alias("digest"))
    asked = places.select("place").distinct().select("place", F.explode(F.array(*ways)).alias("x")).select("place", "x.*")
    beside = nodes.where(F.col("level") < top).withColumn("up", F.floor(F.col("i") / fan))
    return asked.join(beside, ["level", "up"]).where("i <> own").select("place", "level", "i", "digest")


def proved(leaves: DataFrame, given: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """place, digest: the root that each leaf (place, digest) and its proof give; to be held against the root that is trusted."""
    now = leaves.select("place", F.col("place").cast("long").alias("i"), "digest")
    for k in range(levels):
        rows = now.union(given.where(F.col("level") == k).select("place", "i", "digest"))
        now = checkpoint(_node(rows, ["place", F.floor(F.col("i") / fan).alias("up")]).select("place", F.col("up").alias("i"), "digest"))
    return now.select("place", "digest")


def differing(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """i, old, new: the leaves in which two trees differ, the digest of one null where it has no such leaf.

    From the top down, only the children of nodes that differ are looked at:
    `fan` nodes a level for each row that changed.
    """
    tops = [t.agg(F.max("level")).first()[0] for t in (old, new)]
    top = max((t for t in tops if t is not None), default=-1)
    apart = None
    for k in range(top, -1, -1):
        a, b = (t.where(F.col("level") == k).select("i", F.floor(F.col("i") / fan).alias("up"), F.col("digest").alias(name)) for t, name in ((old, "old"), (new, "new")))
        if apart is not None:
            ups = apart.select(F.col("i").alias("up"))
            a, b = a.join(ups, "up", "left_semi"), b.join(ups, "up", "left_semi")
        both = a.drop("up").join(b.drop("up"), "i", "full")
        apart = checkpoint(both.where(~F.col("old").eqNullSafe(F.col("new"))))
    if apart is None:
        return old.select("i", F.col("digest").alias("old"), F.col("digest").alias("new")).where("false")
    return apart.select("i", "old", "new")
