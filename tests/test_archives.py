"""Archives: index, digests, pieces, and what is broken."""

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import archives, artifacts


def put(path, items, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in items:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "elsewhere"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


ITEMS = [("a.txt", b"alpha"), ("empty", b""), ("n" * 150 + "/long", bytes(range(256)) * 40), ("a.txt", b"again"), ("l", None)]


@pytest.mark.parametrize("mode,name", [("w", "x.tar"), ("w:gz", "x.tgz")])
def test_members_by_ranges_or_streams(spark, tmp_path, mode, name):
    put(tmp_path / name, ITEMS, mode)
    rows = archives.index(archives.found(spark, str(tmp_path)))
    got = archives.digested(rows).orderBy("nth").collect()
    assert [(r.member, r.kind, r.size) for r in got] == [(n, "link" if d is None else "file", len(d or b"")) for n, d in ITEMS]
    assert [r.sha256 for r in got] == [None if d is None else hashlib.sha256(d).hexdigest() for _, d in ITEMS]
    for piece in (7, 4096, 1 << 20):
        parts = archives.contents(rows, piece).orderBy("nth", "piece").collect()
        whole = {}
        for r in parts:
            assert len(r.content) <= piece
            whole[r.nth] = whole.get(r.nth, b"") + bytes(r.content)
        assert whole == {i: d for i, (_, d) in enumerate(ITEMS) if d is not None}
    assert archives.digests(archives.found(spark, str(tmp_path))).first().sha256 == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()


@pytest.mark.parametrize("mode,suffix", [("w", "tar"), ("w:gz", "tgz")])
def test_broken_and_empty_archives(spark, tmp_path, mode, suffix):
    put(tmp_path / f"none.{suffix}", [], mode)
    import random

    noise = random.Random(1).randbytes(50_000)
    put(tmp_path / f"cut.{suffix}", [("first", b"1"), ("second", noise)], mode)
    whole = (tmp_path / f"cut.{suffix}").read_bytes()
    (tmp_path / f"cut.{suffix}").write_bytes(whole[:20_000])
    (tmp_path / f"junk.{suffix}").write_bytes(b"no archive at all" * 100)
    rows = archives.index(archives.found(spark, str(tmp_path)))
    name = F.regexp_extract("archive", r"([a-z]+)\.[a-z]+$", 1).alias("name")
    got = {(r.name, r.member, r.problem) for r in rows.select(name, "member", "problem").collect()}
    assert got == {("cut", "first", None), ("cut", None, "broken archive"), ("junk", None, "broken archive")}
    assert [bytes(r.content) for r in archives.contents(rows).where("member = 'first'").collect()] == [b"1"]
    problems = artifacts.member_problems(rows.withColumnRenamed("archive", "path"), ["first"])
    assert {r.problem for r in problems.collect()} == {"broken archive"}


@pytest.mark.parametrize("zipped", [False, True])
def test_written_and_read_back(spark, tmp_path, zipped):
    rows = spark.range(0, 3000, 1, 3).select(F.concat(F.col("id"), F.lit(".txt")).alias("member"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("é"), F.col("id").cast("int")).cast("binary")).alias("content"), F.lit(1).alias("size"))
    archives.write(rows, str(tmp_path / "out"), zipped)
    files = archives.found(spark, str(tmp_path / "out"))
    assert files.count() == 3
    back = archives.digested(archives.index(files)).select("member", "sha256")
    want = rows.select("member", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256"))
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    with pytest.raises(Exception, match="never replaced"):
        rows.sparkSession.dataSource.register(archives.TarSource)
        rows.select("member", "content").write.format("tar").mode("overwrite").save(str(tmp_path / "out"))


def test_an_archive_larger_than_a_buffer_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK", 1 << 20)
    put(tmp_path / "big.tar", [("zeros", bytes(9 << 20)), ("tail", b"t")])
    parts = archives.contents(archives.index(archives.found(spark, str(tmp_path))), 1 << 20)
    assert parts.rdd.getNumPartitions() >= 10
    assert parts.groupBy("member").agg(F.sum(F.length("content")).alias("n")).orderBy("member").collect() == [("tail", 1), ("zeros", 9 << 20)]
    assert archives.index(archives.found(spark, str(tmp_path), "*.none")).count() == 0
