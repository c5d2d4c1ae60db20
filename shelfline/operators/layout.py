"""Rows partitioned by date and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["date_partition", "region"]


def dated_sales(fact: DataFrame, dim_date: DataFrame, dim_store: DataFrame) -> DataFrame:
    """The fact with ``full_date`` and ``region``."""
    return fact.join(dim_date.select("date_key", F.col("date").alias("full_date")), "date_key").join(
        dim_store.select("store_key", "region"), "store_key"
    )


def write_partitioned(rows: DataFrame, path: str, period: str = "day") -> None:
    """Write rows with ``full_date`` and ``region`` by period and region; a re-run replaces only the partitions it touches.

    ``period`` is day by default; month suits data with few rows per day. The
    rebalance hint groups each partition's rows into few files and lets adaptive
    execution split a partition that holds most of the rows.
    """
    first = F.date_format(F.date_trunc(period, "full_date"), "yyyy-MM-dd")
    (
        rows.withColumn("date_partition", first)
        .hint("rebalance", *PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """The whole layout. Its folders are listed here, once for all reads of the frame."""
    return spark.read.parquet(path)


def on_days(rows: DataFrame, first: str, last: str, period: str = "day") -> DataFrame:
    """The rows from ``first`` to ``last``, both included; Spark scans the folders of these periods only.

    Days without sales have no folder and so no rows.
    """
    begin, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    oldest = F.lit(f"{first[:8]}01" if period == "month" else first).cast("date")
    in_folders = rows.where(F.col("date_partition").between(oldest, end))
    return in_folders.where(F.col("full_date").between(begin, end))


def in_region(rows: DataFrame, region: str) -> DataFrame:
    """All days of one region, from its folders only."""
    return rows.where(F.col("region") == region)
