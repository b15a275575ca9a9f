"""Folders of the shared file system, through the file system Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern``, sorted; none if there is nothing."""
    system, target = _at(spark, pattern)
    return sorted(status.getPath().toString() for status in system.globStatus(target) or [])


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.delete(target, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes under ``path``."""
    system, target = _at(spark, path)
    return system.getContentSummary(target).getLength()
