"""JSON values gone through level by level, by Spark's own variants: no Python worker parses a record.

A level's containers are exploded into what they hold, with what each inherits:
its path, the name it stands below, and whether it is protected. The values of
a record are rows of their own, so a large or deep record is spread like any
other table; as many rounds are run as the deepest record has levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..sources.tables import checkpoint

CONTAINERS = ["OBJECT", "ARRAY"]


def nodes(df: DataFrame, id: str, record: str, protected: list[str] | None = None, reenter: bool = False) -> DataFrame:
    """id, depth, path, step, key, kind, text, protected for each value below the records, which are no rows themselves.

    step is the name in an object, null in an array; key the nearest name above
    or at a value. text is that of a string, null of anything else. A value
    below a protected name is protected, itself included. With `reenter`,
    strings that are JSON objects or arrays and not protected are gone through
    in turn, below `~`, where nothing is inherited. Texts that are no JSON, and
    nulls, have no values; ids may repeat or be null.
    """
    names = F.lit(protected or []).cast("array<string>")
    parsed = F.try_parse_json(F.col(record))
    level = df.select(F.col(id).alias("id"), parsed.alias("v"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("protected")).where("v IS NOT NULL")
    spark, depth, found = df.sparkSession, 0, []
    while True:
        depth += 1
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "step", "value"))
        step = F.coalesce(F.concat(F.lit("."), F.col("step")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inside = inside.select("id", F.concat("path", step).alias("path"), "step", F.coalesce("step", "key").alias("key"), F.col("value").alias("v"), (F.col("protected") | F.coalesce(F.array_contains(names, F.col("step")), F.lit(False))).alias("protected"))
        inside = checkpoint(inside.withColumn("kind", jsonx.kind(F.col("v"))).withColumn("text", F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))))
        if inside.isEmpty():
            break
        found.append(inside.select("id", F.lit(depth).alias("depth"), "path", "step", "key", "kind", "text", "protected"))
        held = F.col("kind").isin(CONTAINERS)
        level = inside.where(held).select("id", "v", "path", "key", "protected")
        if reenter:
            again = F.when(F.col("text").isNotNull() & ~F.col("protected"), F.try_parse_json("text"))
            level = inside.select("id", F.when(held, F.col("v")).otherwise(again).alias("v"), F.when(held, F.col("path")).otherwise(F.concat("path", F.lit("~"))).alias("path"), F.when(held, F.col("key")).alias("key"), (held & F.col("protected")).alias("protected"), held.alias("held"))
            level = level.where(F.col("v").isNotNull() & (F.col("held") | jsonx.kind(F.col("v")).isin(CONTAINERS))).drop("held")
    if not found:
        return inside.select("id", F.lit(depth).alias("depth"), "path", "step", "key", "kind", "text", "protected")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def leaves(df: DataFrame, id: str, record: str, protected: list[str]) -> DataFrame:
    """id, path, key, value, protected: the strings of the records, and of records that stand in strings."""
    told = nodes(df, id, record, protected, reenter=True)
    return told.where("text IS NOT NULL").select("id", "path", "key", F.col("text").alias("value"), "protected")


def name_counts(df: DataFrame, id: str, record: str, names: list[str]) -> DataFrame:
    """id, n: how often these names stand in the records, at any depth; only ids that have some."""
    told = nodes(df, id, record)
    return told.where(F.col("step").isin(names)).groupBy("id").agg(F.count("*").alias("n"))
