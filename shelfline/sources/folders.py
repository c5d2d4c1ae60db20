"""Names in shared folders, and marks that make a finished step visible, through the Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder, sorted; none if it does not exist."""
    fs, path = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, whose name says what is done."""
    fs, hadoop_path = _at(spark, path)
    fs.create(hadoop_path, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    fs, hadoop_path = _at(spark, path)
    fs.delete(hadoop_path, True)
