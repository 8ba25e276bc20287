"""What the operators of this subpackage share: tables, the shared folder, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder that
    goes when Python ends; a cluster gets a folder in its warehouse.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if sc.master == "local" or sc.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder; a lost executor takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def key_text(c: str | Column) -> Column:
    """A column as text to hash; null is a value of its own."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def uniform(*parts: Column) -> Column:
    """A double within (0, 1) that only the parts decide: 52 bits of the MD5 of them, joined by '|'."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """128 bits that only rows with the same key and text share.

    The parts are hashed with their lengths, nulls as nulls: no two rows with
    different parts are hashed as one text.
    """
    said = lambda c: F.coalesce(F.concat(F.octet_length(docs[c].cast("string")).cast("string"), F.lit(":"), docs[c].cast("string")), F.lit("-"))
    return F.md5(F.concat(said(key), said(text)))


#: Rows of some 40 bytes that may be broadcast.
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than that; df is checkpointed by then."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a table, as its rows are told to be, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def bounded_bytes(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows have no more bytes than that together; df is checkpointed by then."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df
