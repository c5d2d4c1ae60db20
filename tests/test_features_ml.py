from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import features, forecast, ml

D0 = date(2024, 1, 1)  # a Monday


def daily(spark, units):
    return spark.createDataFrame([("p1", "s1", D0 + timedelta(days=d), u) for d, u in units.items()], "product_id string, store_id string, date date, units long")


def test_trailing_window_counts_empty_days(spark):
    got = {r["date"]: r for r in features.trailing_sales(daily(spark, {0: 7, 3: 7, 6: 7, 7: 14})).collect()}
    assert got[D0]["avg_sales_7d"] == 1.0
    assert got[D0 + timedelta(days=6)]["avg_sales_7d"] == 3.0
    last = [0, 0, 7, 0, 0, 7, 14]  # days 1..7
    mean = sum(last) / 7
    std = (sum((x - mean) ** 2 for x in last) / 6) ** 0.5
    assert got[D0 + timedelta(days=7)]["avg_sales_7d"] == 4.0
    assert got[D0 + timedelta(days=7)]["stddev_sales_7d"] == pytest.approx(std, abs=1e-6)


def test_features_and_labels(spark):
    stock = spark.createDataFrame([("p1", "s1", D0, 50), ("p1", "s1", D0 + timedelta(days=9), 2)], "product_id string, store_id string, date date, stock_level int")
    categories = spark.createDataFrame([("p1", "toys"), ("p2", "food")], "product_id string, category string")
    d = daily(spark, {0: 7, 7: 21})
    f = features.stock_features(d, stock, categories, F.lit(D0 + timedelta(days=7)))
    assert rows(f, "current_stock", "avg_sales_7d", "category_encoded") == [(2.0, 3.0, 1)]
    # an idle pair and one that never sold stay, with mean 0
    more = stock.union(spark.createDataFrame([("p2", "s9", D0, 4)], stock.schema))
    idle = features.stock_features(d, more, categories, F.lit(D0 + timedelta(days=200)))
    assert rows(idle, "product_id", "current_stock", "avg_sales_7d", "stddev_sales_7d") == [("p1", 2.0, 0.0, 0.0), ("p2", 4.0, 0.0, 0.0)]
    history = features.history_features(d, more, categories)
    assert rows(history, "product_id", "date", "avg_sales_7d") == [("p1", D0, 1.0), ("p1", D0 + timedelta(days=9), 0.0), ("p2", D0, 0.0)]
    assert rows(features.with_labels(f), "risk", "reorder_qty") == [(1, 4.0)]
    assert rows(features.with_labels(f.withColumn("current_stock", F.lit(9.0))), "risk", "reorder_qty") == [(0, 0.0)]


def test_forecast_by_weekday(spark):
    units = {7 * w: 8 for w in range(8)}          # every Monday 8
    units[1] = 16                                 # one Tuesday 16
    d = daily(spark, units)
    as_of = F.lit(D0 + timedelta(days=55))
    days = {r["forecast_date"]: r for r in forecast.daily_forecast(d, d, as_of).collect()}
    assert len(days) == 7
    assert days[D0 + timedelta(days=56)]["forecast"] == 8.0 and days[D0 + timedelta(days=56)]["lower_bound"] == 8.0
    assert days[D0 + timedelta(days=57)]["forecast"] == 2.0 and days[D0 + timedelta(days=57)]["lower_bound"] == 0.0
    assert days[D0 + timedelta(days=58)]["forecast"] == 0.0
    stock = spark.createDataFrame([("p1", "s1", 5.0)], "product_id string, store_id string, current_stock double")
    week = forecast.weekly_forecast(d, stock, as_of).first()
    assert week["forecast_7d"] == 10.0 and week["days_remaining"] == 3.5
    assert week["lower_bound"] <= 10.0 <= week["upper_bound"]
    other = spark.createDataFrame([("p2", "s1", 5.0)], stock.schema)  # stocked, idle for all eight weeks
    idle = forecast.weekly_forecast(d, other, as_of).first()
    assert (idle["forecast_7d"], idle["upper_bound"], idle["days_remaining"]) == (0.0, 0.0, None)
    assert [r["forecast"] for r in forecast.daily_forecast(d, other, as_of).collect()] == [0.0] * 7


@pytest.fixture(scope="module")
def scored(spark):
    f = spark.range(200).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"), F.lit("s1").alias("store_id"),
        (F.col("id") % 40).cast("double").alias("current_stock"), ((F.col("id") * 7) % 30).cast("double").alias("avg_sales_7d"),
        (F.col("id") % 5).cast("double").alias("stddev_sales_7d"), (F.col("id") % 3).cast("int").alias("category_encoded"))
    return f, ml.score(ml.fit(ml.training_rows(f), trees=20, rounds=30), f)


def test_models_learn_the_rule(scored):
    f, scores = scored
    joined = scores.join(features.with_labels(f).select("product_id", "risk", "reorder_qty"), "product_id").collect()
    assert len(joined) == 200
    right = sum((r["risk_probability"] > 0.5) == (r["risk"] == 1) for r in joined)
    assert right / 200 > 0.85
    mean = sum(r["reorder_qty"] for r in joined) / 200
    rss = sum((r["reorder_qty"] - r["recommended_reorder"]) ** 2 for r in joined)
    assert 1 - rss / sum((r["reorder_qty"] - mean) ** 2 for r in joined) > 0.7
    assert all(0 <= r["ml_confidence"] <= 100 for r in joined)


def test_quality_on_rows_that_were_held_out(scored):
    f, _ = scored
    models = ml.fit(ml.training_rows(f.where(~ml.held_out(f)), limit=150), trees=20, rounds=60)
    got = ml.quality(models, f.where(ml.held_out(f))).first()
    assert 0 < got["n_rows"] < 80 and got["accuracy"] > 0.75 and got["r2"] > 0.6
    assert ml.training_rows(f, limit=20).count() == 20


def test_one_class_only_still_scores(spark, scored):
    f, _ = scored
    safe = f.withColumn("current_stock", F.lit(1000.0))
    assert ml.score(ml.fit(ml.training_rows(safe), trees=3, rounds=3), safe).where("risk_level = 'Low'").count() == 200


def test_ranking_feed_and_high_risk(spark, scored):
    _, scores = scored
    order = [r["risk_rank"] for r in ml.risk_ranking(scores).collect()]
    assert order == sorted(order, reverse=True)
    forecast_rows = scores.select("product_id", "store_id", F.lit(7.0).alias("forecast_7d"), F.lit(9.0).alias("upper_bound"), F.lit(1.0).alias("lower_bound"), F.col("current_stock").alias("days_remaining"))
    log = ml.reasoning_log(scores, forecast_rows, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    older = log.withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("risk_level", F.lit(3))
    both = log.unionByName(older)
    assert ml.latest_predictions(both).count() == 200
    product = scores.select("product_id", F.col("product_id").alias("name")).distinct()
    store = spark.createDataFrame([("s1", "Store")], "store_id string, store_name string")
    high = ml.high_risk(both, product, store).collect()
    assert len(high) <= 20 and all(r["risk_level"] >= 2 for r in high)
    days = [r["days_remaining_forecast"] for r in high]
    assert days == sorted(days)
    feed = ml.decision_feed(log, F.lit("2024-01-02 05:00:00").cast("timestamp_ntz")).collect()
    assert len(feed) == 20 and {r["age"] for r in feed} == {"5h ago"}
    assert all((r["status"] == "pending") == (r["impact"] in ("Risk Level: 2", "Risk Level: 3")) for r in feed)
    assert ml.recent_predictions(both, 5).count() == 5


def test_trees_see_each_distinct_row_of_features_once(spark, scored):
    f, scores = scored
    more = f.withColumn("store_id", F.explode(F.array(*(F.lit(f"s{i}") for i in range(1, 6)))))
    models = ml.fit(ml.training_rows(f), trees=3, rounds=3)
    every = ml.score(models, more)
    seen = [p for p in every.inputFiles() if "distinct-scores" in p]
    assert seen and spark.read.parquet(*seen).count() == f.select(*features.FEATURES).distinct().count()
    assert every.count() == 1000 and every.groupBy("product_id").agg(F.countDistinct("risk_probability").alias("n")).where("n > 1").isEmpty()


def test_history_deals_sales_and_counts_once(spark):
    stock = spark.createDataFrame([("p1", "s1", D0, 50), ("p1", "s1", D0, None), ("p1", "s1", D0 + timedelta(days=1), None)], "product_id string, store_id string, date date, stock_level int")
    categories = spark.createDataFrame([("p1", "toys")], "product_id string, category string")
    history = features.history_features(daily(spark, {0: 7}), stock, categories)
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(product_id" in line and "store_id" in line]) == 1
    assert rows(history, "date", "current_stock", "avg_sales_7d") == [(D0, 50.0, 1.0), (D0 + timedelta(days=1), None, 0.0)]


def test_log_over_scores_joins_only_pairs_with_sales(spark):
    scores = spark.createDataFrame([("p1", "s1", 5.0, 2.0, 1.0, "High", 0.7, 4), ("p2", "s1", 9.0, 0.0, 0.0, "Low", 0.1, 0)], "product_id string, store_id string, current_stock double, avg_sales_7d double, stddev_sales_7d double, risk_level string, risk_probability double, recommended_reorder int")
    d, last, now = daily(spark, {0: 8, 7: 8}), F.lit(D0 + timedelta(days=7)), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    joined = ml.reasoning_log(scores, forecast.weekly_forecast(d, scores, last), now)
    beside = ml.forecast_log(scores, d, last, now)
    assert beside.columns == joined.columns and rows(beside) == rows(joined)
