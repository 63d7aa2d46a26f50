"""Files on the session's file systems, by their URI: local, HDFS or any store that
Spark itself can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *[p.strip("/") for p in parts[1:]]])


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if it does not exist)."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the application ends."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.delete(p, True)
