"""Records in text files: JSON lines with strict rules, lockfiles, run directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators.rules import RuleError


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, nth (rising along a file), line: the lines of text files, empty ones left out.

    nth orders the lines of a file as they stand, also where a file is read in
    several splits; it is not the line's number, which no split can know.
    """
    return _lines(spark, path).where(F.length(F.trim("line")) > 0)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # Within a block the ids rise; blocks of a file rise by their start.
    return text.select("file", F.struct("block", "id").alias("nth"), "line")


def problem(line: Column) -> Column:
    """Why a line is no record; null if it is a JSON object without repeated keys."""
    v = jsonx.variant(line)
    return F.when(v.isNull(), "no JSON, or a key twice").when(jsonx.kind(v) != "OBJECT", "no object")


def read_lax(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, record (JSON text), problem: every line, bad ones with their reason."""
    return lines(spark, path).select("file", "nth", F.col("line").alias("record"), problem(F.col("line")).alias("problem"))


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, record; RuleError that names the first bad line by file and number, or a path without records."""
    rows = read_lax(spark, path)
    found = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("problem").isNotNull(), F.struct("file", "nth", "problem", F.substring("record", 1, 80).alias("start")))).alias("bad")).first()
    if found["bad"] is not None:
        bad = found["bad"]
        raise RuleError(f"{bad['file']}:{_number(spark, path, bad)}: {bad['problem']}: {bad['start']}")
    if not found["n"]:
        raise RuleError(f"{path}: no records")
    return rows.drop("problem")


def _number(spark: SparkSession, path: str, row: Row) -> int:
    """The number of a line within its file, blank lines counted: those up to it, wherever they were read."""
    at = F.struct(F.lit(row["nth"]["block"]).cast("long").alias("block"), F.lit(row["nth"]["id"]).cast("long").alias("id"))
    return _lines(spark, path).where((F.col("file") == row["file"]) & (F.col("nth") <= at)).count()


def ends(spark: SparkSession, path: str) -> DataFrame:
    """file, problem: files whose last line has no line feed, or that have a blank line, or nothing at all."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.octet_length("value").alias("n"), (F.length(F.trim("value")) == 0).alias("blank"))
    # A file whose every line ends in a line feed has as many bytes as its lines and one more for each.
    per = text.groupBy("file").agg((F.sum("n") + F.count("*")).alias("told"), F.max("bytes").alias("bytes"), F.max("blank").alias("blank"))
    return per.select("file", F.when(F.col("told") != F.col("bytes"), "the last line has no line feed").when(F.col("blank"), "a blank line").alias("problem")).where("problem IS NOT NULL")


def line_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, record, digest: SHA-256 of each line with its line feed; RuleError for a line without one, a blank line or a bad record."""
    bad = ends(spark, path).agg(F.min(F.struct("file", "problem")).alias("b")).first()["b"]
    if bad is not None:
        raise RuleError(f"{bad['file']}: {bad['problem']}")
    return read_strict(spark, path).withColumn("digest", F.sha2(F.concat("record", F.lit("\n")), 256))


def typed(rows: DataFrame, schema: str, record: str = "record") -> DataFrame:
    """The records as columns; a record that does not fit the schema raises."""
    return rows.select(F.from_json(record, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def document(spark: SparkSession, path: str) -> DataFrame:
    """file, record: whole files as one JSON object each; RuleError if one is none."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    bad = rows.select("file", problem(F.col("record")).alias("problem")).where("problem IS NOT NULL").agg(F.min(F.struct("file", "problem")).alias("b")).first()["b"]
    if bad is not None:
        raise RuleError(f"{bad['file']}: {bad['problem']}")
    return rows


def numbered_problem(log: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """group, nth, number: rows of a generation log whose number is not their place in it, from 1."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return log.select(group, nth.alias("nth"), number).where(F.col(number) != F.col("nth"))


def pins(spark: SparkSession, path: str) -> DataFrame:
    """name, version of a lockfile's `name==version` lines; of a name pinned twice the last stands."""
    found = lines(spark, path).select("nth", F.regexp_extract("line", r"^([A-Za-z0-9_.-]+)==([^\s;\\]+)", 1).alias("name"), F.regexp_extract("line", r"^([A-Za-z0-9_.-]+)==([^\s;\\]+)", 2).alias("version"))
    return found.where("name <> ''").groupBy(F.lower("name").alias("name")).agg(F.max_by("version", "nth").alias("version"))


def pin_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, version, expected, problem: pins that are missing or of another version."""
    both = expected.withColumnRenamed("version", "expected").join(found, "name", "left")
    return both.select("name", "version", "expected", F.when(F.col("version").isNull(), "missing").when(F.col("version") != F.col("expected"), "another version").alias("problem")).where("problem IS NOT NULL")


def runs(spark: SparkSession, path: str, pattern: str, *names: str) -> DataFrame:
    """record and, from the file's path by the pattern's groups, the columns `names`; files whose path does not match are left out."""
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    rows = rows.where(F.regexp_like("file", F.lit(pattern)) & (F.length(F.trim("record")) > 0))
    return rows.select(*[F.regexp_extract("file", pattern, i).alias(n) for i, n in enumerate(names, 1)], "record")
