"""A ledger that several writers settle at once, and publications that leave nothing behind."""

import os
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import transitions as log
from millrace.sources import files, sinks


def test_one_version_has_one_writer(spark, tmp_path):
    at = str(tmp_path / "ledger")
    assert log.version(spark, at) == -1
    with pytest.raises(ValueError):
        log.reserve(spark, at, "a", "1")
    assert log.begin(spark, at, "100") and not log.begin(spark, at, "5")
    before = log.entry(spark, at, 0)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(spark, f"{at}/{1:020d}.json", f'{{"i": {i}}}'), range(8)))
    assert won.count(True) == 1
    assert files.text_of(spark, f"{at}/{1:020d}.json") == f'{{"i": {won.index(True)}}}'
    assert sorted(os.listdir(at))[:2] == [f"{0:020d}.json", f"{1:020d}.json"] and not [n for n in os.listdir(at) if n.startswith("_")]
    assert log.entry(spark, at, 0) == before


def test_settlers_at_once(spark, tmp_path):
    at = str(tmp_path / "ledger")
    log.begin(spark, at, "100")
    for key in "abcd":
        log.reserve(spark, at, key, "10.5")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: log.settle(spark, at, k, "3.0000000000000000000001"), ["a", "b", "a", "c"]))
    assert versions[0] == versions[2] and sorted({*versions}) == [5, 6, 7] and log.version(spark, at) == 7
    last = log.entry(spark, at, 7)
    assert [Decimal(last[c]) for c in log.BALANCE] == [Decimal("9.0000000000000000000003"), Decimal("10.5"), Decimal("19.5000000000000000000003"), Decimal(100)]
    rows = log.entries(spark, at)
    assert rows.count() == 8 and log.problems(rows).count() == 0
    assert log.settle(spark, at, "a", "9") == versions[0]  # again: nothing changes
    for call in (lambda: log.settle(spark, at, "d", "11"), lambda: log.reserve(spark, at, "e", "99")):
        with pytest.raises(PySparkException):
            call()
    with pytest.raises(ValueError):
        log.settle(spark, at, "unknown", "1")
    assert log.version(spark, at) == 7


def test_broken_logs_are_told(spark, tmp_path):
    at = str(tmp_path / "ledger")
    log.begin(spark, at, "10")
    log.reserve(spark, at, "a", "4")
    log.settle(spark, at, "a", "3")
    rows = log.entries(spark, at)
    told = lambda df: [tuple(r) for r in log.problems(df).orderBy("version").collect()]
    assert told(rows) == [] == told(rows.where("false"))
    assert told(rows.where("version <> 1")) == [(2, "the version before is missing")]
    change = lambda column, value, v: rows.withColumn(column, F.when(F.col("version") == v, value).otherwise(F.col(column)))
    assert told(change("posted", "4", 2)) == [(2, "posted and outstanding are not what is committed")]
    assert told(change("cost", "2", 2)) == [(2, "a settlement moved something else")]
    assert told(change("authorized", "2", 1)) == [(1, "more is committed than authorized"), (2, "the authorization changed")]


def test_published_once_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "table")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.range(100, numPartitions=3).mapInPandas(seen, "id long").withColumn("text", F.when(F.col("id") % 2 == 0, "x")).withColumn("at", F.rand())
    assert sinks.publish(df, at) == {"rows": 100} and read.value == 100
    assert spark.read.parquet(at).count() == 100
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(3), at)
    lossy = spark.createDataFrame([("a",)], "c string").select(F.raise_error(F.lit("no")).cast("string").alias("c"))
    with pytest.raises(PySparkException):
        sinks.publish(lossy, str(tmp_path / "other"))
    staged, there = str(tmp_path / "_staged"), files.beside(at)
    spark.range(2).write.parquet(staged)
    assert not files.place(spark, staged, at) and there != at
    files.delete(spark, staged)
    assert sorted(os.listdir(tmp_path)) == ["table"]
    assert sinks.publish(spark.range(0), str(tmp_path / "none")) == {"rows": 0}
