from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.session import fresh_path
from shelfline.sources import readers
from shelfline.streaming import orders as live
from shelfline.streaming import partials as P

SPEC = "order_id long, timestamp timestamp_ntz, product_id string, store_id string, quantity int, price double, customer_id string"
START = datetime(2024, 1, 1)


def order(i, price=None):
    return (i, START + timedelta(hours=i % 97), "p1", "s1", i % 3 + 1, 1.25 * (i % 50) if price is None else price, f"c{i % 7}" if i % 5 else None)


def write(spark, path, data):
    spark.createDataFrame(data, SPEC).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return live.event_time(live.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1))


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_live_runs_follow_the_merges(fan):
    """Playing the merges of every batch leaves exactly the runs that are read."""
    there = set()
    for batch in range(70):
        there.add((0, batch))
        for level, parts in P.merges(batch, fan):
            assert len(parts) == fan
            there -= {(level - 1, p) for p in parts}
            there.add((level, batch))
        assert sorted(there) == sorted(P.live_runs(batch + 1, fan))
        assert len(there) <= (fan - 1) * (len(P.live_runs(batch + 1, fan)) + 1)
    assert P.live_runs(0, fan) == []


@pytest.fixture(scope="module")
def late(spark):
    """Fifty files out of time order; every order comes again in a far later file."""
    path = fresh_path(spark, "late-orders")
    for part in range(50):
        at = (part * 17) % 50
        write(spark, path, [order(i) for i in range(at * 4, at * 4 + 4)] + [order((i * 31) % 200) for i in range(part)][:3])
    return path


def test_partials_over_many_batches(spark, late):
    """Equal to the batch form, and each batch wrote its own sums only."""
    folder = fresh_path(spark, "partials")
    source = stream(spark, late).select(F.to_date("timestamp").alias("day"), "customer_id", F.lit(1).alias("n"))
    partials, batches = P.run_partials(source, folder, ["day", "customer_id"], 4)
    table = spark.read.parquet(late)
    want = table.groupBy(F.to_date("timestamp").alias("day"), "customer_id").agg(F.count("*").alias("n"))
    assert batches == 50
    assert rows(partials.state(spark, batches)) == rows(want)
    day = START.date() + timedelta(days=2)
    assert rows(partials.state(spark, batches, F.col("day") == F.lit(day))) == rows(want.where(F.col("day") == F.lit(day)))
    assert len(partials.runs(batches)) == len(P.live_runs(50, 4)) <= 3 * 3
    last = spark.read.parquet(P._run(partials.folder, 0, 49))
    assert last.agg(F.sum("n")).first()[0] <= 7  # the rows of one file
    assert not readers.path_exists(spark, P._run(partials.folder, 0, 0))  # merged and gone
    # The last batch once more: the same folders, the same state.
    again = spark.createDataFrame(last.collect(), last.schema)
    partials.add(again, 49)
    assert rows(partials.state(spark, 50)) == rows(want)


def test_a_second_run_goes_on(spark):
    path, folder = fresh_path(spark, "orders"), fresh_path(spark, "partials")
    write(spark, path, [order(i) for i in range(10)])

    def counted():
        return P.run_partials(stream(spark, path).select("customer_id", F.lit(1).alias("n")), folder, ["customer_id"], 2)

    first, batches = counted()
    assert batches == 1
    write(spark, path, [order(i) for i in range(10, 30)])
    second, batches = counted()
    assert batches == 2
    want = spark.read.parquet(path).groupBy("customer_id").agg(F.count("*").alias("n"))
    assert rows(second.state(spark, batches)) == rows(want)


def test_dedup_state_meets_only_the_ids_of_a_batch(spark, late):
    """50 batches: each updates as many state rows as it has ids, whatever came before."""
    progress = []
    once = live.run_dedup(stream(spark, late), "t", watch=progress.append)
    table = spark.read.parquet(late)
    assert sorted(r["order_id"] for r in once.collect()) == sorted(r["order_id"] for r in table.select("order_id").distinct().collect())
    assert rows(once.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))) == rows(table.distinct())
    assert len(progress) == 50
    assert all(p["updated"] <= 7 for p in progress) and progress[-1]["total"] == 200
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_dedup_keeps_the_smallest_of_the_first_batch(spark):
    path = fresh_path(spark, "twice")
    write(spark, path, [order(1, 5.0), order(1, 3.0), order(2, 9.0), order(1, 4.0)])
    write(spark, path, [order(1, 1.0), order(2, 1.0), order(3, 2.0), (None, START, "p", "s", 1, 1.0, None), (None, START, "q", "s", 1, 1.0, None)])
    once = {r["order_id"]: r["price"] for r in live.run_dedup(stream(spark, path), "t").collect()}
    table = spark.read.parquet(path)
    assert set(once) == {1, 2, 3, None} and table.count() == 9
    assert once[1] in (3.0, 1.0) and once[3] == 2.0 and (once[1], once[2]) in ((3.0, 9.0), (1.0, 1.0))


def test_metrics_and_rates_equal_the_batch_form(spark):
    path = fresh_path(spark, "some-orders")
    for part in (3, 0, 9, 1, 7, 2, 8, 4, 6, 5):
        write(spark, path, [order(i) for i in range(part * 11, part * 11 + 16)])
    table = spark.read.parquet(path)
    got = live.run_daily_metrics(stream(spark, path), "t")
    assert rows(got) == rows(live.metrics_by_day(table))
    rate = live.run_quarantine_rate(stream(spark, path), "t", minutes=60, threshold=2)
    want = table.groupBy(F.window("timestamp", "60 minutes").alias("w")).agg(F.count("*").alias("issue_count"))
    assert rows(rate, "window_start", "issue_count") == rows(want.select("w.start", "issue_count"))
