"""File and table sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp(at: datetime) -> str:
    return at.strftime("%Y%m%dT%H%M%S")


def write_snapshot(df: DataFrame, folder: str, table: str, at: datetime) -> str:
    """``{table}_{yyyyMMddTHHmmss}.parquet`` under ``folder``; returns the path."""
    path = f"{folder}/{table}_{stamp(at)}.parquet"
    df.write.parquet(path)
    return path


def write_quarantine(df: DataFrame, folder: str, table: str, at: datetime) -> str:
    """CSV of rejected rows with their reason; returns the path."""
    path = f"{folder}/{table}_quarantine_{stamp(at)}.csv"
    df.write.option("header", True).csv(path)
    return path


def rebuild(df: DataFrame, path: str) -> None:
    """Drop-and-load: the target holds exactly ``df`` afterwards."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a log or live table."""
    df.write.mode("append").parquet(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
