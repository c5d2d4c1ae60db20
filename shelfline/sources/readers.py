"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.schemas import raw_schema


def path_exists(spark: SparkSession, path: str) -> bool:
    """Metadata check through the Hadoop file system, so it also works on shared storage."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hadoop_path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header. Types are sniffed only when no schema is given (drift detection)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_by_position(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header is wrong: names and types are taken from ``schema`` by position."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_by_position(spark, path, raw_schema("inventory"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One file, a folder or a glob such as ``customers_*``."""
    return spark.read.parquet(path)


def read_snapshots(spark: SparkSession, path_glob: str) -> DataFrame:
    """All snapshots matching a glob, each row with the stamped name it came from."""
    return spark.read.parquet(path_glob).withColumn(
        "snapshot_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+_\d{8}T\d{6}\.parquet)", 1)
    )


def read_latest_snapshot(spark: SparkSession, path_glob: str) -> DataFrame:
    """Only the newest snapshot: names carry their time stamp, so the greatest is the latest.

    Chosen from the file listing, so older snapshots are never scanned.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path_glob)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    if not found:
        raise FileNotFoundError(f"no snapshot matches {path_glob}")
    return spark.read.parquet(max(status.getPath().toString() for status in found))


def read_csv_or_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType | None = None
) -> DataFrame:
    """CSV when it exists, else Parquet, else an error naming both."""
    if path_exists(spark, csv_path):
        return read_csv(spark, csv_path, schema)
    if path_exists(spark, parquet_path):
        return read_parquet(spark, parquet_path)
    raise FileNotFoundError(f"no input found: neither {csv_path} nor {parquet_path}")


def register(df: DataFrame, view: str) -> DataFrame:
    """Make a frame usable from SQL under a name."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.table(view)
