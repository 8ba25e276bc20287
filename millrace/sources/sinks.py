"""Writers: canonical JSON lines, publications that never overwrite, freshness checks, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import review
from . import files


def canonical_lines(df: DataFrame, record: str = "record", ascii_only: bool = False) -> DataFrame:
    """value: each record as JSON with sorted keys and no spaces, numbers as written."""
    return df.select(jsonx.canonical_bytes(F.col(record), ascii_only).alias("value"))


def write_lines(df: DataFrame, path: str, record: str = "record", ascii_only: bool = False) -> None:
    """Canonical JSON lines at a new path; fails if the path exists."""
    canonical_lines(df, record, ascii_only).write.mode("errorifexists").text(path)


def fingerprint(columns: list[str]) -> list[Column]:
    """rows, digest: a count and an order-free digest of rows, 60 bits of each row's SHA-256 summed up."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    bits = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest")]


def publish(df: DataFrame, path: str) -> dict[str, int]:
    """An immutable table: staged beside its place, read back, held against what was written, and then given its name.

    The input is computed once: its count and digest are taken by the pass that
    writes it. What differs, or a name that is taken, is an error, and leaves
    nothing behind. Returns the number of rows.
    """
    spark, staged = df.sparkSession, files.beside(path)
    if files.names(spark, path):
        raise FileExistsError(path)
    told = Observation()
    try:
        df.observe(told, *fingerprint(df.columns)).write.mode("errorifexists").parquet(staged)
        back = spark.read.parquet(staged).agg(*fingerprint(df.columns)).first().asDict()
        if back != told.get:
            raise ValueError(f"{path} would not hold what was to be published: {told.get['rows']} rows written, {back['rows']} read, or others")
        if not files.place(spark, staged, path):
            raise FileExistsError(path)
    finally:
        files.delete(spark, staged)
    return {"rows": back["rows"]}


def stale(fresh: DataFrame, path: str) -> DataFrame:
    """missing, surplus: how a stored table differs from what would be written now; both 0 if it is fresh."""
    return review.coverage(fresh, fresh.sparkSession.read.parquet(path).select(*fresh.columns))


def report(df: DataFrame, title: Column, fields: dict[str, Column], flow: Column) -> DataFrame:
    """A Markdown section for each row: heading, fields as a list, then the flow (an array of steps) joined by arrows."""
    listed = [F.concat(F.lit(f"- {name}: "), F.coalesce(c.cast("string"), F.lit("none"))) for name, c in fields.items()]
    return df.select(F.concat_ws("\n", F.concat(F.lit("## "), title), F.lit(""), *listed, F.concat(F.lit("- flow: "), F.array_join(flow, " → ")), F.lit("")).alias("section"))


def manifest(df: DataFrame, by: str, digest: Column) -> DataFrame:
    """by, n, digest: counts and an order-free digest of each group's rows, one row a group.

    The digest sums 64 bits of each row's SHA-256, so it needs no order and is
    merged before the shuffle.
    """
    bits = F.conv(F.substring(F.sha2(digest, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))


def pretty(value: object) -> str:
    """A manifest's text: keys sorted, two spaces a level, a line feed at the end."""
    return json.dumps(value, indent=2, sort_keys=True) + "\n"


def manifest_text(df: DataFrame, by: str, digest: Column) -> str:
    """manifest() as one document, groups by name; there are as many rows as groups."""
    return pretty({str(r[by]): {"n": r["n"], "digest": r["digest"]} for r in manifest(df, by, digest).collect()})
