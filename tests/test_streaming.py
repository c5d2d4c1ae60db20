from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.session import fresh_path
from shelfline.streaming import orders as live

SPEC = "order_id long, timestamp timestamp_ntz, product_id string, store_id string, quantity int, price double, customer_id string"


@pytest.fixture(scope="module")
def folder(spark):
    """Three files in time order, so that one file per batch gives three batches."""
    path = fresh_path(spark, "stream-in")
    start = datetime(2024, 1, 1)
    for part in range(3):
        data = []
        for i in range(part * 40, part * 40 + 40):
            # two thirds of the orders are for one pair
            pair = ("p1", "s1") if i % 3 else (f"p{i % 5}", "s2")
            data.append((i, start + timedelta(hours=i), *pair, i % 3 + 1, 1.25 * i, f"c{i % 7}"))
        spark.createDataFrame(data, SPEC).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def table(spark, folder):
    return spark.read.parquet(folder)


def stream(spark, folder):
    return live.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def test_append_takes_every_row(spark, folder, table):
    assert rows(live.run_append(stream(spark, folder), "t")) == rows(table)


def test_dedup(spark, folder, table):
    twice = live.event_time(stream(spark, folder)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    assert rows(live.run_append(live.dedup(twice, "10 days"), "t"), "order_id") == rows(table, "order_id")


def test_daily_metrics_equal_batch_over_several_batches(spark, folder, table):
    got = live.run_updates(live.daily_metrics(live.event_time(stream(spark, folder)), "1 day"), "t", ["day"])
    want = table.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("orders"), F.sum(F.col("price") * F.col("quantity")).alias("revenue"))
    assert rows(got, "day", "orders", "revenue") == rows(want)
    day = live.day_metrics(table, F.lit("2024-01-02").cast("date")).first()
    assert (day["orders_today"], day["unique_customers"]) == (24, 7)
    empty = live.day_metrics(table, F.lit("2030-01-02").cast("date")).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0)


@pytest.fixture(scope="module")
def shuffled(spark):
    """The same orders in files that are days out of time order, some orders in two files."""
    path = fresh_path(spark, "stream-late")
    start = datetime(2024, 1, 1)
    for part in (2, 0, 1):
        ids = [*range(part * 40, part * 40 + 40), *range(90, 95)]
        data = [(i, start + timedelta(hours=i), "p1", "s1", i % 3 + 1, 1.25 * i, f"c{i % 7}") for i in ids]
        spark.createDataFrame(data, SPEC).coalesce(1).write.mode("append").parquet(path)
    return path


def test_late_rows_are_not_lost(spark, shuffled):
    table = spark.read.parquet(shuffled)
    once = live.run_dedup(live.event_time(stream(spark, shuffled)), "t")
    assert sorted(r["order_id"] for r in once.collect()) == list(range(120))
    got = live.run_daily_metrics(live.event_time(stream(spark, shuffled)), "t")
    day = F.to_date("timestamp").alias("day")
    want = table.groupBy(day).agg(F.count("*").alias("orders"), F.sum(F.col("price") * F.col("quantity")).alias("revenue"), F.countDistinct("customer_id").alias("unique_customers"))
    assert rows(got, "day", "orders", "revenue", "unique_customers") == rows(want)
    rate = live.run_quarantine_rate(live.event_time(stream(spark, shuffled)), "t", minutes=1440, threshold=2)
    assert sum(r["issue_count"] for r in rate.collect()) == table.count()


def test_a_folder_without_files_gives_no_rows(spark, tmp_path):
    empty = live.event_time(live.read_stream(spark, str(tmp_path), spark.createDataFrame([], SPEC).schema))
    assert live.run_append(empty, "t").count() == 0
    assert live.run_updates(live.daily_metrics(empty, "1 day"), "t", ["day"]).count() == 0
    assert live.run_recent(empty, "t").count() == 0
    assert live.run_dedup(empty, "t").count() == 0
    assert live.run_daily_metrics(empty, "t").count() == 0


def test_recent_orders_survive_batches(spark, folder, table):
    got = [r["order_id"] for r in live.run_recent(stream(spark, folder), "t", 50).collect()]
    assert got == [r["order_id"] for r in live.recent(table, 50).collect()] == list(range(119, 69, -1))


def test_alerts_and_messages_equal_batch(spark, folder, table):
    scores = spark.createDataFrame(
        [("p1", "s1", "Critical", 91.5, 7), ("p3", "s2", "High", 70.0, 3), ("p0", "s2", "Medium", 50.0, 1)],
        "product_id string, store_id string, risk_level string, ml_confidence double, recommended_reorder int")
    got = live.run_append(live.alerts(stream(spark, folder), scores, 4), "t")
    want = table.join(scores.where("risk_level <> 'Medium'"), ["product_id", "store_id"])
    assert rows(got, "order_id", "risk_level", "confidence", "recommended_reorder") == rows(want, "order_id", "risk_level", "ml_confidence", "recommended_reorder")
    texts = [r["value"] for r in live.run_append(live.messages(stream(spark, folder), scores, 4), "t").collect()]
    assert len(texts) == table.count() + want.count()
    assert '{"type":"order","order_id":1,"product_id":"p1","store_id":"s1","price":1.25}' in texts
    assert '{"type":"ml_alert","product_id":"p1","store_id":"s1","risk_level":"Critical","confidence":91.5,"reorder":7}' in texts


def test_quarantine_rate(spark, folder):
    got = live.run_updates(live.quarantine_rate(live.event_time(stream(spark, folder)), "1 day", minutes=180, threshold=2), "t", ["window_start"])
    assert rows(got, "issue_count", "is_high") == [(3, True)] * 40


def test_repeated_batch_writes_the_same(spark, table):
    folder = fresh_path(spark, "t")
    live._write_batch(table, 0, folder)
    live._write_batch(table, 0, folder)
    assert spark.read.parquet(f"{folder}/batch_id=0").count() == table.count()


def test_only_hot_pairs_repeat_the_scores(spark):
    """Rows of the static side: one each, and one more per share of orders of a hot pair."""
    from shelfline.operators import rows as R

    keys = ["product_id", "store_id"]
    orders = spark.createDataFrame([(i, "p1" if i < 700 else f"p{i % 50}", "s1") for i in range(1000)], "order_id long, product_id string, store_id string")
    scores = spark.createDataFrame([(f"p{i}", "s1", i) for i in range(500)], "product_id string, store_id string, score int")
    hot = R.hot_keys(orders, keys, 100)
    assert rows(hot) == [("p1", "s1", 8)]
    assert R.repeated(scores, hot, keys).count() == 500 + 7
    assert rows(R.hot_join(orders, scores, keys, 100)) == rows(orders.join(scores, keys).select("product_id", "store_id", "order_id", "score"))
    assert R.repeated(scores, R.hot_keys(orders, keys, 1000), keys).count() == 500


def test_alerts_of_batches_equal_a_join(spark, folder, table):
    scores = spark.createDataFrame([("p1", "s1", "High", 80.0, 3), ("p2", "s2", "Low", 10.0, 0), ("p3", "s2", "Critical", 95.0, 9)], "product_id string, store_id string, risk_level string, ml_confidence double, recommended_reorder int")
    want = table.join(scores.where("risk_level <> 'Low'"), ["product_id", "store_id"]).select("order_id", "risk_level")
    got = live.run_alerts(stream(spark, folder), scores, "t", share=10)
    assert rows(got, "order_id", "risk_level") == rows(want)
    assert rows(live.batch_alerts(table, scores, 10), "order_id", "risk_level") == rows(want)
    assert live.run_messages(stream(spark, folder), scores, "t").count() == table.count() + want.count()
