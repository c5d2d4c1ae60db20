import re
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators import access, dims, facts, features, layout
from shelfline.plans import kpi
from shelfline.session import fresh_path, stash

NOW = "2024-06-01 00:00:00"


@pytest.fixture(scope="module")
def star(spark):
    people = spark.createDataFrame(
        [("c1", "Ann", "ann@x.org", "+91-1111", "Delhi"), ("c2", "Bo", "bo@x.org", None, "Pune")],
        "customer_id string, name string, email string, phone string, city string")
    products = spark.createDataFrame([("p1", "pen", "office", 2.0), ("p2", "ink", "office", 5.0)], "product_id string, product_name string, category string, base_price double")
    stores = spark.createDataFrame([("s1", "A", "Delhi"), ("s2", "B", "Mumbai"), ("s3", "C", "Mumbai")], "store_id string, store_name string, city string")
    sales = spark.createDataFrame(
        [
            ("1-1", datetime(2024, 1, 31, 10), "s1", "c1", "p1", 3, 2.0, 1.0),
            ("1-2", datetime(2024, 1, 31, 10), "s2", "c1", "p2", 1, 5.0, None),
            ("2-1", datetime(2024, 2, 1), "s3", "c2", "p2", 2, 5.0, 0.0),
            ("3-1", datetime(2024, 2, 29), "s2", "c1", "p2", 30, 5.0, 0.0),
            ("4-1", datetime(2024, 2, 29), "s2", "c9", "p2", 1, 5.0, 0.0),   # unknown customer
            ("5-1", datetime(2024, 2, 29), "s2", None, "p2", 1, 5.0, 0.0),
            ("6-1", datetime(2023, 2, 28), "s2", "c1", "p2", 1, 5.0, 0.0),   # outside the calendar
        ],
        "transaction_id string, date timestamp_ntz, store_id string, customer_id string, product_id string, quantity int, price double, discount double")
    t = {
        "dim_customer": dims.dim_customer(people, F.lit(NOW).cast("timestamp_ntz")),
        "dim_product": dims.dim_product(products),
        "dim_store": dims.dim_store(stores),
        "dim_date": dims.dim_date(spark),
    }
    t["fact_sales"] = facts.fact_sales(sales, t["dim_customer"], t["dim_product"], t["dim_store"], t["dim_date"])
    return t


def test_fact_drops_what_cannot_be_resolved(star):
    assert rows(X.edge(star["fact_sales"]), "sale_id", "date_key", "revenue", "discount") == [
        ("1-1", 20240131, 5.0, 1.0), ("1-2", 20240131, 5.0, 0.0), ("2-1", 20240201, 10.0, 0.0), ("3-1", 20240229, 150.0, 0.0)]


def test_only_current_customers_join(star, spark):
    old = star["dim_customer"].withColumn("is_current", F.lit(False)).withColumn("customer_key", F.lit(99).cast("long"))
    sales = spark.createDataFrame([("1-1", datetime(2024, 1, 1), "s1", "c1", "p1", 1, 1.0, 0.0)], "transaction_id string, date timestamp_ntz, store_id string, customer_id string, product_id string, quantity int, price double, discount double")
    fact = facts.fact_sales(sales, star["dim_customer"].unionByName(old), star["dim_product"], star["dim_store"], star["dim_date"])
    assert rows(fact, "customer_key") == [(1,)]


def test_daily_and_monthly(star):
    daily = kpi.daily_revenue(star["fact_sales"], star["dim_date"]).collect()
    assert [(r["date"], r["daily_revenue"], r["transaction_count"], r["day_type"]) for r in daily] == [
        (date(2024, 2, 29), 150.0, 1, "Weekday"), (date(2024, 2, 1), 10.0, 1, "Weekday"), (date(2024, 1, 31), 10.0, 2, "Weekday")]
    assert kpi.recent_daily_revenue(star["fact_sales"], star["dim_date"], 2).count() == 2
    monthly = kpi.monthly_revenue(star["fact_sales"], star["dim_date"]).collect()
    assert [(r["month_name"], r["monthly_revenue"], r["prev_month_revenue"], r["revenue_growth_pct"]) for r in monthly] == [
        ("January", 10.0, None, None), ("February", 160.0, 10.0, 1500.0)]
    seasonal = kpi.seasonal_demand(star["fact_sales"], star["dim_date"]).collect()
    assert sum(r["revenue_share_pct"] for r in seasonal) == pytest.approx(100, abs=0.02)


def test_city_sales(star):
    got = kpi.city_sales(star["fact_sales"], star["dim_store"]).collect()
    assert [(r["city"], r["region"], r["active_stores"], r["total_revenue"], r["total_units_sold"]) for r in got] == [
        ("Mumbai", "West", 2, 165.0, 33), ("Delhi", "North", 1, 5.0, 3)]
    assert sum(r["revenue_share_pct"] for r in got) == pytest.approx(100, abs=0.02)


def test_top_products_share_is_of_all_sales(star):
    got = kpi.top_products(star["fact_sales"], star["dim_product"], 1).collect()
    assert [(r["product_id"], r["revenue_rank"], r["revenue_share_pct"], r["avg_product_price"]) for r in got] == [("p2", 1, 97.06, 5.0)]


def test_turnover(star):
    got = {r["product_id"]: r for r in kpi.turnover(star["fact_sales"], star["dim_product"]).collect()}
    p2 = got["p2"]
    assert (p2["days_sold"], p2["avg_daily_sales"], p2["movement_category"]) == (3, 11.0, "Fast Moving")
    assert (p2["sales_span_days"], p2["sales_span_true_days"]) == (98, 29)  # key difference against calendar days
    assert (p2["projected_monthly_sales"], p2["projected_annual_sales"]) == (330.0, 4015.0)
    assert kpi.turnover(star["fact_sales"], star["dim_product"], 1).first()["product_id"] == "p2"


def test_turnover_merges_equal_products(star, spark):
    twin = star["dim_product"].where("product_id = 'p2'").withColumn("product_key", F.lit(7).cast("long"))
    moved = star["fact_sales"].withColumn("product_key", F.when(F.col("sale_id") == "1-2", 7).otherwise(F.col("product_key")).cast("long"))
    extra = moved.where("sale_id = '3-1'").withColumn("product_key", F.lit(7).cast("long"))
    got = kpi.turnover(moved.unionByName(extra), star["dim_product"].unionByName(twin)).where("product_id = 'p2'").collect()
    assert len(got) == 1 and got[0]["days_sold"] == 3 and got[0]["total_sold"] == 63


def test_new_and_returning(star):
    no_one = star["fact_sales"].where("sale_id = '2-1'").withColumn("customer_key", F.lit(None).cast("long"))
    got = kpi.new_vs_returning(star["fact_sales"].unionByName(no_one), star["dim_date"]).collect()
    assert [(r["date"], r["total_customers"], r["new_customers"], r["returning_customers"], r["total_revenue"]) for r in got] == [
        (date(2024, 2, 29), 1, 0, 1, 150.0), (date(2024, 2, 1), 1, 1, 0, 20.0), (date(2024, 1, 31), 1, 1, 0, 10.0)]
    assert all(r["new_customers"] + r["returning_customers"] == r["total_customers"] for r in got)


def test_customer_value(star):
    city = {r["city"]: r for r in kpi.customer_value_by_city(star["fact_sales"], star["dim_customer"]).collect()}
    assert (city["Delhi"]["city_tier"], city["Delhi"]["purchase_frequency_segment"], city["Delhi"]["value_segment"]) == ("Metro", "Occasional", "Low Value")
    assert (city["Pune"]["city_tier"], city["Pune"]["purchase_frequency_segment"]) == ("Tier-1", "One-time")
    assert city["Delhi"]["avg_clv"] == city["Delhi"]["avg_transaction_value"]
    person = kpi.customer_value(star["fact_sales"], star["dim_customer"]).collect()
    assert [(p["customer_id"], p["total_revenue"], p["customer_lifespan_days"], p["customer_lifespan_true_days"]) for p in person] == [("c1", 160.0, 98, 29), ("c2", 10.0, 0, 0)]


def test_summary_cards_and_charts(star):
    assert [tuple(r) for r in kpi.summary(star["fact_sales"]).collect()][:2] == [("Total Revenue", 170.0, "₹170.00"), ("Total Transactions", 4.0, "4")]
    cards = kpi.dashboard_cards(star["fact_sales"], star["dim_date"], star["dim_store"], star["dim_customer"]).first()
    assert (cards["total_revenue"], cards["last_revenue"], cards["prev_revenue"], cards["revenue_trend_pct"]) == (170.0, 150.0, 10.0, 1400.0)
    assert (cards["total_cities"], cards["total_stores"], cards["total_customers"]) == (2, 3, 2)
    chart = kpi.revenue_chart(star["fact_sales"], star["dim_date"]).collect()
    assert [(r["pct_of_max"], r["is_above_avg"]) for r in chart][0] == (100.0, True)
    people = kpi.customer_chart(star["fact_sales"], star["dim_customer"]).collect()
    assert sum(r["customer_pct"] for r in people) == pytest.approx(100)
    assert kpi.city_chart(star["fact_sales"], star["dim_store"], 1).first()["pct_of_max"] == 100.0


def test_empty_fact(star):
    none = star["fact_sales"].where("quantity < 0")
    cards = kpi.dashboard_cards(none, star["dim_date"], star["dim_store"], star["dim_customer"]).first()
    assert (cards["total_revenue"], cards["revenue_trend_pct"], cards["total_stores"]) == (0.0, 0.0, 0)
    assert kpi.city_sales(none, star["dim_store"]).count() == 0


def test_last_days_by_key_and_by_calendar(star):
    assert facts.last_days(star["fact_sales"], 30).count() == 2          # 20240229 - 30 = 20240199: from 1 February
    assert facts.last_days(star["fact_sales"], 30, true_days=True).count() == 4  # from 30 January
    combos = kpi.top_combos(star["fact_sales"], star["dim_product"], star["dim_store"], k=1).collect()
    assert [tuple(r) for r in combos] == [("p2", "s2", 150.0)]


def test_delivery_median(star, spark):
    days = [1, 2, 2, 9, 10]
    ship = spark.createDataFrame(
        [(f"h{i}", s, date(2024, 2, 1), date(2024, 2, 1 + d)) for i, (s, d) in enumerate(zip(["1-1", "1-2", "2-1", "3-1", "3-1"], days))] + [("hx", "zz", date(2024, 2, 1), date(2024, 2, 3))],
        "shipment_id string, transaction_id string, ship_date date, delivery_date date")
    fact = facts.fact_shipments(ship, star["fact_sales"])
    assert fact.count() == 5
    r = kpi.delivery_by_month(fact, star["dim_date"]).first()
    assert (r["total_deliveries"], r["median_delivery_days"], r["min_delivery_days"], r["max_delivery_days"], r["avg_delivery_days"], r["on_time_pct"]) == (5, 2.0, 1.0, 10.0, 4.8, 60.0)
    even = kpi.delivery_by_month(fact.where("delivery_time <> 1"), star["dim_date"]).first()
    assert even["median_delivery_days"] == 5.5


def test_inventory(star, spark):
    raw = spark.createDataFrame([("s1", "p1", date(2024, 1, 2), 5), ("s1", "p8", date(2024, 1, 2), 6), ("s9", "p1", date(2024, 1, 2), 7)], "store_id string, product_id string, date date, stock_level int")
    fact = facts.fact_inventory(raw, star["dim_product"], star["dim_store"])
    assert rows(fact, "date_key", "product_key", "store_key", "stock_level", "reorder_point", "inventory_id") == [(20240102, 1, 1, 5, 20, None)]
    assert rows(facts.inventory_load_counts(raw, star["dim_product"], star["dim_store"])) == [(3, 1, 2)]
    assert rows(features.stocked_pairs(fact, star["dim_product"], star["dim_store"])) == [("p1", "s1")]


def test_views(star):
    analyst = {r["sale_id"]: r for r in access.view("analyst", star).collect()}
    assert analyst["1-1"]["phone_masked"] == "XXXXX-1111" and analyst["2-1"]["phone_masked"] == "XXXXX-"
    assert analyst["1-1"]["email_masked"] == "a***@x.org"
    assert not {"name", "email", "phone"} & set(access.view("analyst", star).columns)
    assert rows(access.view("store_manager", star, store_key=3), "sale_id") == [("2-1",)]
    profit = {r["sale_id"]: r["profit"] for r in X.edge(access.view("finance", star)).collect()}
    assert profit == {"1-1": -1.0, "1-2": 0.0, "2-1": 0.0, "3-1": 0.0}
    admin = {r["table_name"]: r for r in access.view("admin", star).collect()}
    assert admin["fact_sales"]["total_revenue"] == 170.0 and admin["dim_customer"]["min_date_key"] is None
    assert access.create_views(star) == ["analyst_sales", "store_manager_sales", "finance_sales", "admin_all"]
    with pytest.raises(ValueError):
        access.view("guest", star)


def test_contract(star, spark):
    assert access.contract_violations(spark, star).count() == 0
    broken = {**star, "dim_product": star["dim_product"].drop("price")}
    del broken["dim_date"]
    assert rows(access.contract_violations(spark, broken)) == [("dim_date", "*"), ("dim_product", "price")]
    with pytest.raises(ValueError):
        access.create_views(broken)


def test_layout_prunes_and_reruns(star, spark):
    path = fresh_path(spark, "layout")
    dated = layout.dated_sales(star["fact_sales"], star["dim_date"], star["dim_store"])
    layout.write_partitioned(dated, path)
    day = layout.on_days(layout.read_partitioned(spark, path), "2024-02-29", "2024-02-29")
    assert rows(X.edge(day), "sale_id", "revenue", "region") == [("3-1", 150.0, "West")]
    everything = layout.read_partitioned(spark, path)
    assert everything.count() == 4
    pruned = everything.where("date_partition = date'2024-02-29' and region = 'West'")
    assert "PartitionFilters: [isnotnull(date_partition" in pruned._jdf.queryExecution().executedPlan().toString()
    layout.write_partitioned(dated, path)
    assert layout.read_partitioned(spark, path).count() == 4
    changed = dated.where("sale_id = '3-1'").withColumn("quantity", F.lit(1))
    layout.write_partitioned(changed, path)
    again = layout.read_partitioned(spark, path)
    assert again.count() == 4 and again.where("sale_id = '3-1'").first()["quantity"] == 1
    month = fresh_path(spark, "layout")
    layout.write_partitioned(dated, month, "month")
    monthly = layout.read_partitioned(spark, month)
    assert rows(layout.on_days(monthly, "2024-02-01", "2024-02-01", "month"), "sale_id") == [("2-1",)]
    # days and regions without sales have no folder and give no rows
    everything, day = again, layout.on_days(again, "2024-02-29", "2024-02-29")
    assert layout.on_days(everything, "2030-01-01", "2030-01-07").count() == 0
    assert layout.in_region(everything, "Nowhere").count() == 0
    west = layout.in_region(everything, "West")
    assert west.count() == everything.where("region = 'West'").count() > 0
    for pruned in (day, west, layout.on_days(everything, "2024-02-01", "2024-02-07"), layout.on_days(monthly, "2024-02-03", "2024-03-02", "month")):
        assert re.search(r"PartitionFilters: \[isnotnull\((date_partition|region)", pruned._jdf.queryExecution().executedPlan().toString())


def test_reports_scan_the_fact_once(star, spark):
    """In final adaptive plans; two scans at most for the cards."""
    fact = stash(star["fact_sales"], "scan-test")
    folder = fact.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    reports = {
        "city": (kpi.city_sales(fact, star["dim_store"]), 1),
        "season": (kpi.seasonal_demand(fact, star["dim_date"]), 1),
        "summary": (kpi.summary(fact), 1),
        "chart": (kpi.city_chart(fact, star["dim_store"]), 1),
        "top": (kpi.top_products(fact, star["dim_product"]), 0),  # reads the written sums
        "cards": (kpi.dashboard_cards(fact, star["dim_date"], star["dim_store"], star["dim_customer"]), 2),
    }
    for name, (report, most) in reports.items():
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        scans = [line for line in plan.splitlines() if "FileScan" in line and folder in line]
        assert len(scans) <= most, (name, len(scans), plan)
        assert name != "summary" or "Expand" not in plan
