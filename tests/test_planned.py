"""Tables that one report alone reads are not written for it."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import features, forecast
from shelfline.plans import catalog, kpi
from shelfline.plans.warehouse import Warehouse


def test_delivery_months_write_no_facts(spark, sf_dir):
    w = Warehouse(spark, sf_dir)
    report = catalog._QUERIES["kpi_delivery_monthly"](w)
    assert not {"fact_shipments", "fact_sales", "transactions_clean"} & set(w._built)
    written = kpi.delivery_by_month(w["fact_shipments"], w["dim_date"])
    assert rows(report) == rows(written) and rows(report)


@pytest.mark.parametrize("name", ["demand_forecast_daily", "demand_forecast_trend"])
def test_daily_forecasts_read_recent_sales_and_pairs_only(spark, sf_dir, name):
    w = Warehouse(spark, sf_dir)
    got = catalog._QUERIES[name](w)
    assert not {"pair_sales", "pair_stock", "fact_inventory", "stock_features"} & set(w._built)
    assert got.count() == 7 * w["stock_features"].count() > 0


def test_recent_sales_give_the_features_of_all_sales(spark, sf_dir):
    w = Warehouse(spark, sf_dir)
    assert rows(w["pair_sales"].agg(F.max("date"))) == rows(spark.range(1).select(w.forecast_day()))
    everything = features.stock_features(w["pair_sales"], w["pair_stock"], w.categories(), w.forecast_day())
    assert rows(w["stock_features"]) == rows(everything)
    assert rows(w.stocked_pairs()) == rows(everything.select("product_id", "store_id"))


def test_pairs_meet_the_profile_before_they_become_days(spark):
    daily = spark.createDataFrame([("a", "s", 3)], "product_id string, store_id string, units long").withColumn("date", F.lit("2024-01-08").cast("date"))
    pairs = spark.createDataFrame([("a", "s"), ("b", "s")], "product_id string, store_id string")
    got = forecast.daily_forecast(daily, pairs, F.lit("2024-01-08").cast("date"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Join")
    assert sorted(r["forecast"] for r in got.collect()) == [0.0] * 13 + [0.375]
