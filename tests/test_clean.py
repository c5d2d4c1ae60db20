from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import clean
from shelfline.plans.warehouse import Warehouse
from shelfline.sources import tables as T

NOW = datetime(2024, 6, 1)
SPEC = "transaction_id string, product_id string, store_id string, quantity int, price double, discount double, date timestamp_ntz"
OK = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(
        [
            ("t1", "p1", "s1", 1, 10.0, None, OK),
            ("t1", "p2", "s1", 1, 11.0, None, OK),          # repeat of t1
            ("t2", "p1", "s1", 2, -10.0, 1.0, OK),          # negative price
            ("t3", None, "s1", 1, 10.0, 1.0, OK),           # no product
            ("t4", "p1", "s1", 0, 10.0, 1.0, OK),           # no quantity
            ("t5", "p1", "s1", 1, 10.0, 1.0, datetime(2025, 5, 1)),  # future
            ("t6", "p1", "s1", 1, 10.0, 1.0, None),         # no date
            (None, "p1", "s1", 1, 10.0, 1.0, OK),           # no id, twice
            (None, "p9", "s1", 1, -10.0, 1.0, OK),
            ("t7", None, "s1", -1, -5.0, None, datetime(2025, 5, 1)),  # several faults: counted once, at the first step
        ],
        SPEC,
    )


def as_of():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")



def order():
    return [F.asc_nulls_last("product_id"), F.asc_nulls_last("price")]


def test_clean_keeps_the_right_rows(spark, dirty):
    got = clean.clean(dirty, as_of(), order())
    assert rows(got, "transaction_id", "product_id", "price", "discount", "is_anomaly") == [
        ("t1", "p1", 10.0, 0.0, False), ("t2", "p1", 10.0, 1.0, False)]


def test_report_counts_each_row_at_its_first_step(spark, dirty):
    r = clean.report(dirty, as_of(), order()).first().asDict()
    assert r == {
        "initial_rows": 10, "duplicates_removed": 2, "nulls_fixed": 2, "critical_rows_removed": 3, "invalid_values_fixed": 1,
        "invalid_quantity_removed": 1, "future_rows_removed": 2, "anomalies_flagged": 0, "final_rows": 2, "rows_removed": 8, "retention_pct": 20.0,
    }
    removed = r["duplicates_removed"] + r["critical_rows_removed"] + r["invalid_quantity_removed"] + r["future_rows_removed"]
    assert removed == r["rows_removed"]


def test_discount_is_created_and_text_dates_parsed(spark):
    df = spark.createDataFrame(
        [("a", "p", "s", 1, 1.0, "2024-01-02 03:04:05"), ("b", "p", "s", 1, 1.0, "not a date"), ("c", "p", "s", 1, 1.0, "2030-01-01")],
        "transaction_id string, product_id string, store_id string, quantity int, price double, date string",
    )
    got = clean.clean_rows(df, as_of(), [F.asc("transaction_id")])
    assert rows(got, "transaction_id", "discount", "date") == [("a", 0.0, datetime(2024, 1, 2, 3, 4, 5))]
    assert clean.report(df, as_of(), [F.asc("transaction_id")]).first()["nulls_fixed"] == 0


def test_anomalies_are_flagged_not_removed(spark):
    df = spark.createDataFrame([(f"t{i}", "p", "s", 1, 100.0 if i == 0 else 1.0, 0.0, OK) for i in range(50)], SPEC)
    got = clean.clean(df, as_of(), [F.asc("transaction_id")])
    assert got.count() == 50 and rows(got.where("is_anomaly"), "transaction_id") == [("t0",)]
    t = clean.price_threshold(df).first()
    prices = [100.0] + [1.0] * 49
    mean = sum(prices) / 50
    std = (sum((p - mean) ** 2 for p in prices) / 49) ** 0.5
    assert t["threshold"] == pytest.approx(mean + 3 * std)


def test_lines_are_shuffled_once_for_join_and_cleaning(spark, sf_dir):
    raw = T.transactions(spark, sf_dir, with_order=True)
    once = clean.clean_rows(raw, T.as_of(), T.transaction_order(), ["order_key", *clean.KEY])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders
    assert "hashpartitioning(transaction_id" not in plan
    by_id = clean.clean_rows(raw.drop("order_key"), T.as_of(), T.transaction_order())
    assert once.columns == by_id.columns
    assert once.exceptAll(by_id).isEmpty() and by_id.exceptAll(once).isEmpty()


def test_a_warehouse_cleans_without_a_wide_copy_of_all_lines(spark, sf_dir):
    built = Warehouse(spark, sf_dir)
    assert built["transactions_clean"].count() > 0
    assert "order_lines" not in built._built and set(built._built) == {"transactions_clean"}
