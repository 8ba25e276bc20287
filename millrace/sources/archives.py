"""Tar archives of any size: an index of their members first, then the members' bytes by ranges.

The index of an uncompressed archive takes one small read a member, from header
to header; after that each member, and each piece of a large one, is a row of
its own that any task can read. A gzipped archive can only be gone through from
its beginning, so one task does that, a buffer at a time. No task holds an
archive or a member whole, whatever their sizes.

Archives lie in any store that Arrow can open by its URI (a mounted folder,
HDFS, object stores); they are found by Spark's own listing.
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .tables import checkpoint

INDEX = "archive string, nth bigint, member string, kind string, at bigint, size bigint, sha256 string, problem string"
#: Bytes read at once, bytes of a piece of a member, bytes that a task is to read.
BUFFER, PIECE, TASK = 1 << 20, 16 << 20, 128 << 20
BROKEN = (tarfile.TarError, EOFError, zlib.error)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path there."""
    plain = re.sub(r"^file:/+", "/", uri)
    if plain.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), plain
    return pyarrow.fs.FileSystem.from_uri(uri)


def _buffers(f, size: int | None = None) -> Iterator[bytes]:
    """What a file gives, up to a size, a buffer at a time."""
    while size is None or size > 0:
        b = f.read(BUFFER if size is None else min(BUFFER, size))
        if not b:
            if size:
                raise EOFError
            return
        yield b
        size = None if size is None else size - len(b)


def _sha256(f, size: int | None = None) -> str:
    h = hashlib.sha256()
    for b in _buffers(f, size):
        h.update(b)
    return h.hexdigest()


def _kind(m: tarfile.TarInfo) -> str:
    if m.isfile():
        return "sparse" if m.issparse() else "file"
    return "dir" if m.isdir() else "link" if m.issym() or m.islnk() else "other"


def _walked(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The members one by one; none is remembered. The end must be marked by a block of zeros: a cut archive is broken."""
    while (m := tar.next()) is not None:
        yield m
        tar.members.clear()


def _opened(uri: str) -> tuple[object, bool]:
    """The file, and whether it is gzipped: told by its first two bytes."""
    fs, path = _store(uri)
    f = fs.open_input_file(path)
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return f, zipped


def _tar(f, zipped: bool) -> tarfile.TarFile:
    return tarfile.open(fileobj=f, mode="r|gz" if zipped else "r:", bufsize=BUFFER)


def found(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """archive, length of the files below a path; they are not opened, and may be of any size."""
    below = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return below.select(F.col("path").alias("archive"), "length")


def digests(archives: DataFrame) -> DataFrame:
    """archive, length, sha256 of whole files, read a buffer at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, length in zip(b["archive"], b["length"], strict=True):
                with _opened(archive)[0] as f:
                    yield pd.DataFrame({"archive": [archive], "length": [length], "sha256": [_sha256(f)]})

    return archives.mapInPandas(digest, "archive string, length bigint, sha256 string")


def index(archives: DataFrame) -> DataFrame:
    """archive, nth, member, kind, at, size, sha256, problem: a row a member, in the archives' order from 0; kept in the shared folder.

    `at` is where a file's bytes begin, null in a gzipped archive, whose
    files have their sha256 here already. kind is file, sparse, dir, link or
    other. A broken archive has the members before the break and a row with its
    problem; one without members has no row. A name in it twice has two rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                rows, nth = [], 0
                f, zipped = _opened(archive)
                with f:
                    try:
                        with _tar(f, zipped) as tar:
                            for m in _walked(tar):
                                plain = _kind(m) == "file"
                                end = m.offset_data + m.size
                                if plain and not zipped and end > f.size():
                                    raise EOFError
                                digest = _sha256(tar.extractfile(m), m.size) if plain and zipped else None
                                rows.append((archive, nth, m.name, _kind(m), m.offset_data if plain and not zipped else None, m.size, digest, None))
                                nth += 1
                                if len(rows) == 1000:
                                    yield _frame(rows)
                                    rows = []
                    except BROKEN:
                        rows.append((archive, nth, None, None, None, None, None, "broken archive"))
                yield _frame(rows)

    return checkpoint(archives.select("archive").mapInPandas(walk, INDEX))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["archive", "nth", "member", "kind", "at", "size", "sha256", "problem"])
    return df.astype({"nth": "Int64", "at": "Int64", "size": "Int64"})


def _dealt(ranges: DataFrame, size: str) -> DataFrame:
    """Rows dealt to as many tasks as their bytes ask for: the rows themselves are small, so their own size would tell nothing."""
    total = ranges.agg(F.sum(size)).first()[0] or 0
    return ranges.repartition(int(total) // TASK + ranges.sparkSession.sparkContext.defaultParallelism, "archive", "at")


def digested(rows: DataFrame) -> DataFrame:
    """The rows of index() with the sha256 of every file; links, folders and problems have none."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, mine in b.groupby("archive"):
                f, _ = _opened(archive)
                with f:
                    shas = []
                    for at, size in zip(mine["at"], mine["size"], strict=True):
                        f.seek(int(at))
                        shas.append(_sha256(f, int(size)))
                yield _frame(mine.assign(sha256=shas).to_records(index=False).tolist())

    reach = F.col("at").isNotNull()
    return _dealt(rows.where(reach), "size").mapInPandas(digest, INDEX).unionByName(rows.where(~reach))


def _frames(pieces: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Pieces (archive, nth, member, piece, content) in data frames of PIECE bytes or 1,000 rows: one for each small piece would cost far more than to read it."""
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p[-1])
        if size >= PIECE or len(held) == 1000:
            yield pd.DataFrame(held, columns=["archive", "nth", "member", "piece", "content"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["archive", "nth", "member", "piece", "content"])


def contents(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """archive, nth, member, piece, content: the files' bytes in pieces, numbered from 0; an empty file is one empty piece.

    Pieces of uncompressed archives are read by their offsets, by many tasks;
    a gzipped archive, gone through again, by one.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for archive, mine in b.groupby("archive"):
                with _opened(archive)[0] as f:
                    for r in mine.itertuples(index=False):
                        f.seek(int(r.at))
                        data = b"".join(_buffers(f, int(r.length)))
                        yield archive, r.nth, r.member, r.piece, data

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for archive in b["archive"]:
                f, zipped = _opened(archive)
                with f, _tar(f, zipped) as tar:
                    try:
                        for nth, m in enumerate(_walked(tar)):
                            if _kind(m) == "file":
                                data = tar.extractfile(m)
                                for k in range(max(1, -(-m.size // piece))):
                                    part = b"".join(_buffers(data, min(piece, m.size - k * piece)))
                                    yield archive, nth, m.name, k, part
                    except BROKEN:  # index() has said so; what stands before the break is whole
                        continue

    schema = "archive string, nth bigint, member string, piece bigint, content binary"
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece).cast("bigint"))
    cut = rows.where("at IS NOT NULL").select("archive", "nth", "member", "at", "size", F.posexplode(starts).alias("piece", "start"))
    cut = cut.select("archive", "nth", "member", (F.col("at") + F.col("start")).alias("at"), F.col("piece").cast("bigint").alias("piece"), F.least(F.col("size") - F.col("start"), F.lit(piece)).alias("length"))
    zipped = rows.where("kind = 'file' AND at IS NULL").select("archive").distinct()
    parallel = zipped.repartition(zipped.count() or 1, "archive")
    return _dealt(cut, "length").mapInPandas(lambda b: _frames(ranges(b)), schema).unionByName(parallel.mapInPandas(lambda b: _frames(streams(b)), schema))


class Wrote(WriterCommitMessage):
    def __init__(self, staged: str, name: str):
        self.staged, self.name = staged, name


class TarWriter(DataSourceWriter):
    """One archive a task, staged under a hidden name and named when all tasks are done.

    A task that fails deletes what it staged, as does the driver where the
    others cannot go on; that of a lost executor stays hidden from readers.
    """

    def __init__(self, path: str, zipped: bool):
        self.path, self.zipped, self.run = path.rstrip("/"), zipped, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{self.run}.{'tgz' if self.zipped else 'tar'}"
        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        staged = f"{folder}/_{name}-{uuid.uuid4().hex}"
        try:
            with fs.open_output_stream(staged) as out, tarfile.open(fileobj=out, mode="w|gz" if self.zipped else "w|") as tar:
                for r in rows:
                    info = tarfile.TarInfo(r["member"])
                    data = bytes(r["content"] or b"")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    tar.members.clear()
        except BaseException:
            fs.delete_file(staged)
            raise
        return Wrote(staged, f"{folder}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.staged, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.staged)


class TarSource(DataSource):
    """df.write.format("tar"): rows of member and content (null: empty) as archives, one a task; option gzip."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, never replaced: use mode append")
        return TarWriter(self.options["path"], self.options.get("gzip", "false").lower() == "true")


def write(rows: DataFrame, path: str, zipped: bool = False) -> None:
    """member, content as archives below a path, one a task."""
    rows.sparkSession.dataSource.register(TarSource)
    rows.select("member", "content").write.format("tar").option("gzip", zipped).mode("append").save(path)
