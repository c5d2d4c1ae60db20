from datetime import datetime

import pytest
from conftest import rows

from shelfline import schemas as S
from shelfline.operators import ingest
from shelfline.session import fresh_path
from shelfline.sources import writers

SCHEMA = S.TableSchema("t", required=["id", "b", "a"], optional=["c"])


def test_reasons_are_sorted_and_joined(spark):
    df = spark.createDataFrame([("1", None, None, 1), ("2", "x", "y", 2), (None, "x", "y", 3)], "id string, a string, b string, extra int")
    valid, bad = ingest.validate_split(df, SCHEMA)
    assert rows(valid) == [("2", "x", "y", 2)]
    assert sorted(r["quarantine_reason"] for r in bad.collect()) == [
        "missing_required_value:a;missing_required_value:b", "missing_required_value:id"]
    assert valid.count() + bad.count() == df.count()
    assert ingest.unknown_columns(df, SCHEMA) == ["extra"]


def test_missing_column_takes_all_rows(spark):
    df = spark.createDataFrame([("1", None), ("2", "x")], "id string, a string")
    valid, bad = ingest.validate_split(df, SCHEMA)
    assert valid.count() == 0
    assert sorted(r["quarantine_reason"] for r in bad.collect()) == [
        "missing_required_column:b", "missing_required_column:b;missing_required_value:a"]


def test_nothing_required_keeps_everything(spark):
    df = spark.createDataFrame([(None,)], "id string")
    valid, bad = ingest.validate_split(df, S.INGEST_REGISTRY["stores"])
    assert valid.count() == 1 and bad.count() == 0


def test_run_writes_both_sides(spark):
    path, out = fresh_path(spark, "csv"), fresh_path(spark, "out")
    spark.createDataFrame([("1", "x", "y"), ("2", "NA", "y"), ("3", "x", None)], "id string, a string, b string").write.option("header", True).csv(path)
    at = datetime(2024, 1, 1)
    counts = ingest.run(spark, "t", path, out, out, at, registry={"t": SCHEMA})
    assert rows(counts) == [("t", 3, 1, 2)]
    assert spark.read.parquet(f"{out}/t_{writers.stamp(at)}.parquet").count() == 1
    bad = spark.read.option("header", True).csv(f"{out}/t_quarantine_{writers.stamp(at)}.csv")
    assert sorted(r["quarantine_reason"] for r in bad.collect()) == ["missing_required_value:a", "missing_required_value:b"]
    with pytest.raises(ValueError):
        ingest.run(spark, "unknown", path, out, out, at)
