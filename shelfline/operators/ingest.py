"""Batch ingest: validate, split into valid and quarantined rows, write both."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.exprs import normalise_nulls
from shelfline.schemas import INGEST_REGISTRY, TableSchema
from shelfline.sources import readers, writers
from shelfline.session import fresh_path, stash

REASON = "quarantine_reason"


def _reasons(df: DataFrame, schema: TableSchema) -> list[Column]:
    """One text per possible reason, NULL where it does not apply, in order of the text."""
    found = {}
    for name in set(schema.required):
        if name not in df.columns:
            text = f"missing_required_column:{name}"
            found[text] = F.lit(text)
        else:
            text = f"missing_required_value:{name}"
            found[text] = F.when(F.col(f"`{name}`").isNull(), F.lit(text))
    return [found[text] for text in sorted(found)]


def with_reasons(df: DataFrame, schema: TableSchema) -> DataFrame:
    """The rows with a ``quarantine_reason`` column (joined by ';'), NULL for valid rows."""
    reasons = _reasons(df, schema)
    text = F.nullif(F.concat_ws(";", *reasons), F.lit("")) if reasons else F.lit(None).cast("string")
    return df.withColumn(REASON, text)


def validate_split(df: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine); unknown columns are kept in both."""
    marked = with_reasons(df, schema)
    return marked.where(F.col(REASON).isNull()).drop(REASON), marked.where(F.col(REASON).isNotNull())


def unknown_columns(df: DataFrame, schema: TableSchema) -> list[str]:
    return sorted(set(df.columns) - set(schema.known))


def run(
    spark: SparkSession,
    table: str,
    csv_path: str,
    out_dir: str,
    quarantine_dir: str,
    at: datetime,
    registry: dict[str, TableSchema] = INGEST_REGISTRY,
    file_schema=None,
) -> DataFrame:
    """Read a CSV, write the valid rows as Parquet and the rest as CSV; returns the counts."""
    schema = registry.get(table)
    if schema is None:
        raise ValueError(f"no schema registered for table {table!r}")
    rows = normalise_nulls(readers.read_csv(spark, csv_path, file_schema))
    # The input is parsed once; both sinks and the counts read the marked copy.
    marked = stash(with_reasons(rows, schema), f"ingest-{table}")
    valid = marked.where(F.col(REASON).isNull()).drop(REASON)
    rejected = marked.where(F.col(REASON).isNotNull())
    if not rejected.isEmpty():
        writers.write_quarantine(rejected, quarantine_dir, table, at)
    if not valid.isEmpty():
        writers.write_snapshot(valid, out_dir, table, at)
    return counts(marked, table)


def counts(marked: DataFrame, table: str) -> DataFrame:
    return marked.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col(REASON).isNull(), 1)).alias("valid_rows"),
        F.count(REASON).alias("quarantined_rows"),
    )


def scratch_run(spark: SparkSession, table: str, csv_path: str, at: datetime, **kwargs) -> tuple[DataFrame, str]:
    """``run`` into a new folder under the shared folder; returns (counts, folder)."""
    folder = fresh_path(spark, f"ingest-{table}")
    return run(spark, table, csv_path, folder, folder, at, **kwargs), folder
