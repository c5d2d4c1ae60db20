from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import runlog


def results(spark):
    return spark.createDataFrame(
        [
            ("b", datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 6, 1), 10, 1, None),
            ("a", datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 0, 0, 30), 20, 2, None),
            ("c", datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12, 0, 5), 30, 3, "boom"),
        ],
        "run_name string, start_time timestamp_ntz, end_time timestamp_ntz, rows_processed long, rows_quarantined long, error_message string")


def test_runs_are_numbered_closed_and_read(spark):
    r = results(spark)
    running = runlog.started(r)
    log = running.unionByName(runlog.finished(running, r.where("run_name <> 'b'")))
    assert log.count() == 5
    assert rows(runlog.latest(log), "run_id", "pipeline_name", "status", "rows_processed", "duration_seconds") == [
        (1, "a", "success", 20, 30), (2, "b", "running", 0, 0), (3, "c", "failed", 0, 5)]
    assert [x["run_id"] for x in runlog.history(log, 2).collect()] == [3, 2]
    assert runlog.last_run(log).first()["run_id"] == 3
    assert rows(runlog.success_rate(log)) == [(3, 100 / 3)]
    later = runlog.started(spark.createDataFrame([("z", datetime(2024, 1, 2))], "run_name string, start_time timestamp_ntz"), log)
    assert later.first()["run_id"] == 4


def test_metrics(spark):
    report = spark.createDataFrame([(2, 3, 4, 98.5)], "duplicates_removed long, nulls_fixed long, anomalies_flagged long, retention_pct double")
    got = rows(runlog.metrics(report, 7, F.lit("2024-01-01").cast("timestamp_ntz")), "metric_id", "run_id", "metric_name", "metric_value")
    assert got == [(1, 7, "duplicates_removed", 2.0), (2, 7, "nulls_fixed", 3.0), (3, 7, "anomalies_flagged", 4.0), (4, 7, "data_quality_score", 98.5)]


def test_retention_and_alert(spark):
    log = spark.createDataFrame([(datetime(2024, 1, 1, 23, 59, 59),), (datetime(2024, 1, 2),), (datetime(2024, 1, 31, 12),)], "timestamp timestamp_ntz")
    as_of = F.lit("2024-02-01 08:00:00").cast("timestamp_ntz")
    assert runlog.retain(log, "timestamp", 30, as_of).count() == 2
    at_noon = F.lit("2024-01-31 12:30:00").cast("timestamp_ntz")
    assert rows(runlog.quarantine_alert(log, at_noon, 30, 0)) == [(1, True)]
    assert rows(runlog.quarantine_alert(log, at_noon, 29, 0)) == [(0, False)]
