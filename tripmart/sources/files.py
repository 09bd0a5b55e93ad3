"""Small control files: created whole and once, listed and read, in whatever store Spark reaches.

``publish`` is what ids, leases and table versions rest on: of several that
create the same file one succeeds, and nobody sees part of it. Local (or
mounted) folders do that by a hard link, HDFS by a rename that never replaces.
Stores that promise neither are refused.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def locate(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all its text; False, and nothing done, where it exists."""
    fs, where = locate(spark, path)
    fs.mkdirs(where.getParent())
    folder = fs.resolvePath(where.getParent()).toUri()  # where a view of several stores leads
    if folder.getScheme() == "file":
        place, draft = (os.path.join(folder.getPath(), name) for name in (where.getName(), f".{uuid.uuid4().hex}"))
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    if folder.getScheme() != "hdfs":
        raise NotImplementedError(f"no way is known to create a file only once in {folder}")
    _, draft = locate(spark, f"{where.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        return fs.rename(draft, where)
    finally:
        fs.delete(draft, False)


def read(spark: SparkSession, path: str) -> str:
    """All of a file; FileNotFoundError if there is none."""
    fs, where = locate(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder, without hidden ones; none if there is no folder."""
    fs, where = locate(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(name for s in fs.listStatus(where) if not (name := s.getPath().getName()).startswith("."))


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written or touched; None if there is none."""
    fs, where = locate(spark, path)
    if not fs.exists(where):
        return None
    return (spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(where).getModificationTime()) / 1000


def touch(spark: SparkSession, path: str) -> None:
    fs, where = locate(spark, path)
    fs.setTimes(where, spark.sparkContext._jvm.System.currentTimeMillis(), -1)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    fs, where = locate(spark, path)
    fs.delete(where, True)
