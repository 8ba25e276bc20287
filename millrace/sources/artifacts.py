"""Files as evidence: digests, bindings, inventories, archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """name (relative to the path), length, sha256 of the files below it; empty files are not seen."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    # Digests are taken where the file is read; only they go on.
    return files(spark, path).select(F.substring("path", F.length(F.lit(root)) + 2, F.lit(1 << 30)).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def inventory_problems(found: DataFrame, recorded: DataFrame, forbidden: str = r"(?:^|/)\.|\.(?:pem|key|env)$") -> DataFrame:
    """name, problem: files that are missing (or empty), surplus, changed or of a forbidden name; recorded has name and sha256."""
    both = found.withColumnRenamed("sha256", "has").join(recorded.withColumnRenamed("sha256", "wants"), "name", "full_outer")
    why = (
        F.when(F.col("has").isNull(), "missing")
        .when(F.regexp_like("name", F.lit(forbidden)), "forbidden name")
        .when(F.col("wants").isNull(), "not recorded")
        .when(F.col("has") != F.col("wants"), "changed")
    )
    return both.select("name", why.alias("problem")).where("problem IS NOT NULL")


def safe_name(c: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~F.regexp_like(c, F.lit(r"(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:|\x00")) & (c != "")


def binding_problems(bindings: DataFrame, found: DataFrame) -> DataFrame:
    """owner, path, problem: bindings (owner, path, sha256) that leave the root, lead nowhere or to other bytes; found is an inventory."""
    both = bindings.join(found.select(F.col("name").alias("path"), F.col("sha256").alias("has")), "path", "left")
    why = F.when(~safe_name(F.col("path")), "path leaves the root").when(F.col("has").isNull(), "no such file").when(F.col("has") != F.col("sha256"), "digest differs")
    return both.select("owner", "path", why.alias("problem")).where("problem IS NOT NULL")


def members(archives: DataFrame) -> DataFrame:
    """path, member, kind, content, problem: what the tar archives (gzipped or not) hold; a broken one has a row with its problem.

    An archive is unpacked in one task, so archives should fit in memory;
    many are unpacked side by side.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for m in tar:
                            f = tar.extractfile(m) if m.isfile() else None
                            rows.append((path, m.name, "file" if m.isfile() else "link" if m.issym() or m.islnk() else "dir" if m.isdir() else "other", f.read() if f else None, None))
                except (tarfile.TarError, EOFError, OSError) as e:
                    rows.append((path, None, None, None, f"broken archive: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["path", "member", "kind", "content", "problem"])

    return archives.select("path", "content").mapInPandas(unpack, "path string, member string, kind string, content binary, problem string")


def member_problems(found: DataFrame, expected: list[str]) -> DataFrame:
    """path, problem: archives that are broken, hold links or unsafe names, or other members than expected."""
    per = found.groupBy("path").agg(
        F.max("problem").alias("broken"), F.bool_or(F.col("kind").isin("link", "other")).alias("links"), F.bool_and(safe_name(F.col("member"))).alias("safe"), F.sort_array(F.collect_set(F.when(F.col("kind") == "file", F.col("member")))).alias("names")
    )
    why = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("links"), "holds links").when(~F.col("safe"), "unsafe member name").when(F.col("names") != F.lit(sorted(expected)), "other members than expected")
    return per.select("path", why.alias("problem")).where("problem IS NOT NULL")
