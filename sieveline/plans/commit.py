"""Files that are written whole or not at all, and once: the first writer wins."""

from __future__ import annotations

import os
import urllib.parse
import uuid

from pyspark.sql import SparkSession


class AlreadyThere(FileExistsError):
    """The file was there, or another writer came first."""


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(uri: str, fs) -> str | None:
    return urllib.parse.unquote(urllib.parse.urlparse(uri).path) if fs.getScheme() == "file" else None


def exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)


def read_text(spark: SparkSession, uri: str) -> str:
    path, fs = _path(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, uri: str, text: str) -> None:
    """Write a new file. Its name appears with its whole content; ``AlreadyThere`` if it exists, also by a writer at the same time.

    On a local file system the name is a hard link to a finished file, elsewhere a rename that doesn't replace; both are
    refused if the name is taken.
    """
    path, fs = _path(spark, uri)
    fs.mkdirs(path.getParent())
    temporary = f"{uri}.{uuid.uuid4().hex}.tmp"
    if local := _local(uri, fs):
        with open(_local(temporary, fs), "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(_local(temporary, fs), local)
        except FileExistsError:
            raise AlreadyThere(uri) from None
        finally:
            os.remove(_local(temporary, fs))
        return
    jvm = spark.sparkContext._jvm
    if fs.exists(path):
        raise AlreadyThere(uri)
    held, _ = _path(spark, temporary)
    out = fs.create(held, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(held, path, none)
    except Exception as e:
        fs.delete(held, False)
        if "FileAlreadyExists" in str(e):
            raise AlreadyThere(uri) from None
        raise


def names(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    path, fs = _path(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def delete(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.delete(path, True)
