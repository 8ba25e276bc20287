"""Joins of intervals that overlap, whatever their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level's cells are so many bits wider than those of the level below.
BITS = 2


def _level(length: Column) -> Column:
    """The least level whose cells are as long as that or longer."""
    return F.ceil(F.length(F.bin(length - 1)) / BITS).cast("int")


def _shift(level: Column) -> Column:
    """How far a level's cells go; those of the last one halve all numbers."""
    return F.least(level * BITS, F.lit(63))


def _cells(start: Column, end: Column, level: Column) -> Column:
    """The cells of a level, whose cells are no shorter than the span, that it touches: one or two."""
    shift = _shift(level)
    return F.array_distinct(F.array(F.call_function("shiftright", start, shift), F.call_function("shiftright", end - 1, shift)))


def overlaps(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """Pairs (group, left, right), left < right by key, of spans of one group that overlap; [start, end) as longs.

    Cells are dyadic. A span belongs to the level whose cells are as long as it
    is, and stands in one or two of them; it is looked up there, and in those
    above that have spans: twice the number of levels at most, which grows with
    the logarithm of the longest span. So a span of ten years is two rows, as
    one of a second is, and is compared with what touches its own cells alone.
    A pair comes once: from the cell that the later start is in, at the level of
    the longer span. Empty spans and nulls overlap nothing.
    """
    rows = spans.where(F.col(start) < F.col(end)).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.withColumn("level", _level(F.col("e") - F.col("s")))
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # 32 at most
    owners = rows.select("g", "level", F.explode(_cells(F.col("s"), F.col("e"), F.col("level"))).alias("cell"), "k", "s", "e")
    above = F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("level"))).alias("at")
    seekers = rows.select("g", "k", "s", "e", "level", above).select("g", F.col("at").alias("level"), F.explode(_cells(F.col("s"), F.col("e"), F.col("at"))).alias("cell"), *[F.col(c).alias(f"{c}2") for c in ("k", "s", "e", "level")])
    both = owners.join(seekers, ["g", "level", "cell"]).where("s < e2 AND s2 < e AND (level2 < level OR k < k2)")
    both = both.where((F.col("k") != F.col("k2")) & (F.call_function("shiftright", F.greatest("s", "s2"), _shift(F.col("level"))) == F.col("cell")))
    return both.select(F.col("g").alias(group), F.least("k", "k2").alias("left"), F.greatest("k", "k2").alias("right"))
