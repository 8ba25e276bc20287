"""Files and folders of the file system that driver and executors share: placed whole, and only where nothing is."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """The Hadoop path, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at), fs


def beside(path: str) -> str:
    """A new hidden name in the same folder: readers of the folder do not see it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def folder(spark: SparkSession, path: str) -> None:
    """A folder of that name, unless it is there."""
    at, fs = _path(spark, path)
    fs.mkdirs(at)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder that are not hidden; none if it is not there."""
    at, fs = _path(spark, folder)
    if not fs.exists(at):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if n[0] not in "._"]


def text_of(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _taken(e: Py4JJavaError) -> bool:
    return "AlreadyExists" in e.java_exception.getClass().getName()


def place(spark: SparkSession, staged: str, path: str) -> bool:
    """Give what is staged its final name; False, and nothing changed, if that name is taken.

    Of several at once one succeeds: a rename that does not overwrite is atomic
    where the file system promises it; on a local one a file is linked, which is.
    """
    jvm = spark.sparkContext._jvm
    (here, fs), (there, _) = _path(spark, staged), _path(spark, path)
    try:
        if here.toUri().getScheme() == "file" and fs.getFileStatus(here).isFile():
            of = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(p.toUri().toString()))
            jvm.java.nio.file.Files.createLink(of(there), of(here))
            fs.delete(here, False)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(here, there, none)
    except Py4JJavaError as e:
        if not _taken(e):
            raise
        return False
    return True


def create(spark: SparkSession, path: str, text: str) -> bool:
    """A file of that text, there whole or not at all; False if the name is taken."""
    staged = beside(path)
    at, fs = _path(spark, staged)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if place(spark, staged, path):
        return True
    fs.delete(at, False)
    return False
