"""Run log: append-only run events, the latest state per run, metrics and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators.dims import next_key
from shelfline.operators.rows import dense_keys, keep_first, top_k

COLUMNS = [
    "run_id", "pipeline_name", "start_time", "end_time", "status",
    "rows_processed", "rows_quarantined", "error_message", "duration_seconds",
]


def started(runs: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """A 'running' event per run, numbered on from the greatest id in the log.

    runs: run_name, start_time.
    """
    start = F.lit(0) if log is None else next_key(log, "run_id")
    numbered = dense_keys(runs.select("start_time", "run_name"), ["start_time", "run_name"], "run_id", start)
    return numbered.select(
        "run_id",
        F.col("run_name").alias("pipeline_name"),
        "start_time",
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit("running").alias("status"),
        F.lit(0).cast("long").alias("rows_processed"),
        F.lit(0).cast("long").alias("rows_quarantined"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).cast("long").alias("duration_seconds"),
    )


def finished(running: DataFrame, results: DataFrame) -> DataFrame:
    """A closing event per run: failed when an error message is given, else success.

    results: run_name, start_time, end_time, rows_processed, rows_quarantined, error_message.
    A failed run keeps zero row counts.
    """
    open_runs = running.select("run_id", F.col("pipeline_name").alias("run_name"), "start_time")
    failed = F.col("error_message").isNotNull()
    zero = F.lit(0).cast("long")
    return open_runs.join(results, ["run_name", "start_time"]).select(
        "run_id",
        F.col("run_name").alias("pipeline_name"),
        "start_time",
        "end_time",
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, zero).otherwise(F.col("rows_processed").cast("long")).alias("rows_processed"),
        F.when(failed, zero).otherwise(F.col("rows_quarantined").cast("long")).alias("rows_quarantined"),
        "error_message",
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("duration_seconds"),
    )


def latest(log: DataFrame) -> DataFrame:
    """State of each run after its last event: a closing event wins over 'running'."""
    return keep_first(log, ["run_id"], [(F.col("status") == "running").asc(), F.desc_nulls_last("end_time")]).select(*COLUMNS)


def history(log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    columns = ["run_id", "start_time", "status", "rows_processed", "rows_quarantined", "duration_seconds"]
    return top_k(latest(log).select(*columns), [F.desc_nulls_last("run_id")], limit)


def last_run(log: DataFrame) -> DataFrame:
    return history(log, 1)


def success_rate(log: DataFrame, limit: int = 50) -> DataFrame:
    """Share of successful runs among the newest ones, in percent."""
    return history(log, limit).agg(
        F.count(F.lit(1)).alias("n_runs"),
        X.ratio(F.count(F.when(F.col("status") == "success", 1)) * 100.0, F.count(F.lit(1))).alias("success_rate_pct"),
    )


def metrics(report: DataFrame, run_id: int, at: Column) -> DataFrame:
    """The four quality metrics of a run as rows; the quality score is the retention rate."""
    named = [
        ("duplicates_removed", "duplicates_removed"),
        ("nulls_fixed", "nulls_fixed"),
        ("anomalies_flagged", "anomalies_flagged"),
        ("data_quality_score", "retention_pct"),
    ]
    items = F.array(
        *[F.struct(F.lit(name).alias("metric_name"), X.dbl(column).alias("metric_value")) for name, column in named]
    )
    return report.select(F.posexplode(items).alias("pos", "m")).select(
        (F.col("pos") + 1).cast("long").alias("metric_id"),
        F.lit(run_id).cast("long").alias("run_id"),
        "m.metric_name",
        "m.metric_value",
        at.alias("timestamp"),
    )


def retain(df: DataFrame, ts_col: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than ``days`` days before the day of ``as_of``."""
    return df.where(F.col(ts_col) >= F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz"))


def quarantine_alert(log: DataFrame, as_of: Column, minutes: int = 30, threshold: int = 100) -> DataFrame:
    """Entries of the last minutes, and whether that is too many."""
    recent = log.where(F.col("timestamp") >= as_of - F.expr(f"INTERVAL '{minutes}' MINUTE"))
    return recent.agg(F.count(F.lit(1)).alias("issue_count")).withColumn("is_high", F.col("issue_count") > threshold)
