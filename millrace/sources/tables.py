"""Parquet tables of a folder, tables kept in the shared folder, and rows numbered in an order."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tasks for each core, where rows are dealt out for their work.
TASKS_A_CORE = 4


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out over all cores: for rows of few bytes and much work, of which a split of a file would give one task very many."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


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


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Column with the range that a row of ranged() is in.
RANGE = "_range"


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, dealt to ranges of the order, with the number of its range: rows of a range come before those of the next. Equal rows share one."""
    return checkpoint(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def before(rows: DataFrame, amount: Column) -> DataFrame:
    """_range and `start`, the sum of the amount over the ranges before it; rows as ranged() gives them. One row a range."""
    w = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(RANGE).agg(F.sum(amount).alias("s"))
    return sums.select(RANGE, F.coalesce(F.sum("s").over(w), F.lit(0)).alias("start"), "s")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its rows' numbers, from 1, in an order.

    Each range of the order is numbered for itself, beginning after the counts
    of those before it: no task has more than its range.
    """
    rows = ranged(df, *order)
    starts = F.broadcast(before(rows, F.lit(1)).select(RANGE, "start"))  # one row a range
    within = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return rows.withColumn(name, within).join(starts, RANGE).withColumn(name, (F.col("start") + F.col(name)).cast("bigint")).drop(RANGE, "start")
