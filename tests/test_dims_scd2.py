from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import dims, scd2

T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def people(spark, *data):
    return spark.createDataFrame([(i, f"name {i}", f"{i}@x", "1", c) for i, c in data], "customer_id string, name string, email string, phone string, city string")


def test_calendar_of_a_leap_year(spark):
    d = dims.dim_date(spark)
    assert d.count() == 366
    assert rows(d.where("date_key = 20240224"), "date", "is_weekend", "is_holiday", "festival_name") == [(date(2024, 2, 24), True, False, None)]
    assert d.where("is_weekend").count() == 104
    covering = dims.dim_date_covering(spark.createDataFrame([(datetime(2024, 1, 30, 5),), (datetime(2024, 2, 2),)], "t timestamp_ntz"), "t")
    assert rows(covering, "date_key") == [(20240130,), (20240131,), (20240201,), (20240202,)]


def test_first_load_and_products(spark):
    dim = dims.dim_customer(people(spark, ("c2", "Pune"), ("c1", "Delhi")), at(T0))
    assert rows(dim, "customer_key", "customer_id", "version", "is_current", "valid_to") == [(1, "c1", 1, True, None), (2, "c2", 1, True, None)]
    products = spark.createDataFrame([("p1", "n", "c", 5)], "product_id string, product_name string, category string, base_price int")
    assert rows(dims.dim_product(products)) == [(1, "p1", "n", "c", None, 5.0)]
    stores = spark.createDataFrame([("s1", "n", " surat")], "store_id string, store_name string, city string")
    store = dims.dim_store(stores)
    assert rows(store, "region") == [("West",)]
    assert rows(dims.store_counts_by_region(store)) == [("West", 1)] and rows(dims.regions(store)) == [("West",)]


def test_insert_new_adds_only_unknown_customers(spark):
    dim = dims.dim_customer(people(spark, ("c1", "Delhi")), at(T0))
    snapshot = people(spark, ("c1", "Pune"), ("c3", "Surat"), ("c3", "Agra"), ("c2", "Goa"))
    after = dims.insert_new(dim, snapshot, at(T1))
    assert rows(after, "customer_key", "customer_id", "city") == [(1, "c1", "Delhi"), (2, "c2", "Goa"), (3, "c3", "Agra")]
    assert dims.insert_new(after, snapshot, at(T1)).count() == 3


def test_scd2_versions_and_is_idempotent(spark):
    dim = dims.dim_customer(people(spark, ("c1", "Delhi"), ("c2", "Pune"), ("c3", None), ("c4", "Goa")), at(T0))
    snapshot = people(spark, ("c1", "Mumbai"), ("c2", "Pune"), ("c3", ""), ("c9", "Agra"))
    once = scd2.apply(dim, snapshot, at(T1))
    assert rows(once.where("customer_id = 'c1'"), "customer_key", "city", "version", "is_current", "valid_to") == [
        (1, "Delhi", 1, False, datetime(2024, 2, 1)), (5, "Mumbai", 2, True, None)]
    assert once.count() == 5  # c3: NULL equals '', c9 is not this operator's business
    again = scd2.apply(once, snapshot, at("2024-03-01 00:00:00"))
    assert rows(again) == rows(once)
    assert {r["violations"] for r in scd2.checks(once).collect()} == {0}
    back = scd2.apply(once, people(spark, ("c1", "Delhi")), at("2024-03-01 00:00:00"))
    assert rows(back.where("customer_id = 'c1' and is_current"), "city", "version", "customer_key") == [("Delhi", 3, 6)]


def test_scd2_takes_one_row_per_customer_from_many_files(spark):
    dim = dims.dim_customer(people(spark, ("c1", "Delhi")), at(T0))
    snapshot = people(spark, ("c1", "Goa"), ("c1", "Pune")).withColumn("seen", F.when(F.col("city") == "Pune", 2).otherwise(1))
    after = scd2.apply(dim, snapshot, at(T1), newest_first=[F.desc("seen")])
    assert rows(after.where("is_current"), "city") == [("Pune",)]
    assert scd2.several_current(after).count() == 0


def test_scd2_other_columns_do_not_trigger(spark):
    dim = dims.dim_customer(people(spark, ("c1", "Delhi")), at(T0))
    renamed = people(spark, ("c1", "Delhi")).withColumn("name", F.lit("new"))
    assert rows(scd2.apply(dim, renamed, at(T1)), "name") == [("name c1",)]
    assert scd2.apply(dim, renamed, at(T1), track=["city", "name"]).count() == 2


def test_scd2_skips_existing_version_and_refuses_duplicates(spark):
    dim = dims.dim_customer(people(spark, ("c1", "Delhi")), at(T0))
    ahead = dim.withColumn("version", F.lit(2)).withColumn("is_current", F.lit(False))
    after = scd2.apply(dim.unionByName(ahead), people(spark, ("c1", "Goa")), at(T1))
    assert after.count() == 2
    broken = dim.unionByName(dim)
    assert rows(scd2.checks(broken)) == [("duplicate_versions", 1), ("no_current", 0), ("several_current", 1)]
    with pytest.raises(ValueError):
        scd2.apply(broken, people(spark, ("c1", "Goa")), at(T1))
