"""KPI reports over the star schema.

Each report sums the fact per foreign key first (partial sums before the
shuffle), joins the dimension to that small result, and sums again to the report
level. A hot customer, product or store thus costs one row per task, and
distinct counts become plain counts of keys. Every report scans the fact once.
Totals for shares are windows over the few rows of the report itself (cities,
months), or come from per-product sums that are written once; unpartitioned
windows occur over such few rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfline import schemas as S
from shelfline.functions import exprs as X
from shelfline.operators.facts import last_days
from shelfline.operators.rows import top_k
from shelfline.session import stash


def _first_sums(fact: DataFrame, *keys: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Sums per key of the fact, or of sums that are kept up to date (``operators.increments``)."""
    if "_rev" in fact.columns:
        return fact.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("_rev", "_n_rev", "_n", "_units")))
    return fact.groupBy(*keys).agg(
        X.sum_money("revenue").alias("_rev"),
        F.count("revenue").alias("_n_rev"),
        F.count("sale_id").alias("_n"),
        F.sum(F.col("quantity").cast("long")).alias("_units"),
        *extra,
    )


def _revenue() -> Column:
    return X.dbl(F.sum("_rev"))


def _mean_revenue() -> Column:
    return X.ratio(X.dbl(F.sum("_rev")), F.sum("_n_rev"))


def _n() -> Column:
    return F.sum("_n")


def _units() -> Column:
    return F.sum("_units")


def _days_between(first: str, last: str) -> Column:
    return F.datediff(X.key_to_date(last), X.key_to_date(first))


# --- revenue over time --------------------------------------------------------
def daily_revenue(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    per_day = _first_sums(fact, "date_key").join(dim_date, "date_key")
    group = ["date", "year", "month", "day", "is_weekend", "is_holiday", "festival_name"]
    return (
        per_day.groupBy(*group)
        .agg(
            _revenue().alias("daily_revenue"),
            _n().alias("transaction_count"),
            _mean_revenue().alias("avg_transaction_value"),
            _units().alias("total_units_sold"),
        )
        .select(
            "date",
            "year",
            "month",
            "day",
            X.flag_label("is_weekend", "Weekend", "Weekday").alias("day_type"),
            X.flag_label("is_holiday", "Holiday", "Regular").alias("holiday_type"),
            "festival_name",
            "daily_revenue",
            "transaction_count",
            "avg_transaction_value",
            "total_units_sold",
        )
        .orderBy(F.desc_nulls_last("date"))
    )


def recent_daily_revenue(fact: DataFrame, dim_date: DataFrame, days: int = 30) -> DataFrame:
    """Revenue of the last days that had sales."""
    per_day = _first_sums(fact, "date_key").join(dim_date.select("date_key", "date"), "date_key")
    rows = per_day.groupBy("date").agg(_revenue().alias("revenue"))
    return top_k(rows, [F.desc_nulls_last("date")], days)


def _per_month(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Month rows with the month before, as the base of both monthly reports."""
    months = (
        _first_sums(fact, "date_key")
        .join(dim_date.select("date_key", "year", "month"), "date_key")
        .groupBy("year", "month")
        .agg(
            _revenue().alias("monthly_revenue"),
            F.sum("_rev").alias("_total"),
            _n().alias("transaction_count"),
            _mean_revenue().alias("avg_transaction_value"),
            _units().alias("total_units_sold"),
        )
    )
    # Twelve rows a year: small enough for one task.
    by_month = Window.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("month"))
    return months.withColumn("prev_month_revenue", F.lag("monthly_revenue").over(by_month)).withColumn(
        "month_name", X.month_name("month")
    )


def monthly_revenue(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _per_month(fact, dim_date).select(
        "year",
        "month",
        "month_name",
        "monthly_revenue",
        "transaction_count",
        "avg_transaction_value",
        "total_units_sold",
        "prev_month_revenue",
        X.growth_pct("monthly_revenue", "prev_month_revenue").alias("revenue_growth_pct"),
    ).orderBy("year", "month")


def seasonal_demand(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    months = _per_month(fact, dim_date)
    total = X.dbl(F.sum("_total").over(Window.partitionBy()))
    return months.select(
        "year",
        "month",
        "month_name",
        X.season("month").alias("season"),
        "monthly_revenue",
        "transaction_count",
        "avg_transaction_value",
        "total_units_sold",
        X.share_pct("monthly_revenue", total).alias("revenue_share_pct"),
        "prev_month_revenue",
        X.growth_pct("monthly_revenue", "prev_month_revenue").alias("month_over_month_growth_pct"),
    ).orderBy("year", "month")


# --- stores and products ------------------------------------------------------
def city_sales(fact: DataFrame, dim_store: DataFrame) -> DataFrame:
    per_store = _first_sums(fact, "store_key").join(dim_store.select("store_key", "city", "region"), "store_key")
    cities = per_store.groupBy("city", "region").agg(
        F.countDistinct("store_key").alias("active_stores"),
        F.sum("_rev").alias("_total"),
        _n().alias("transaction_count"),
        _mean_revenue().alias("avg_transaction_value"),
        _units().alias("total_units_sold"),
    )
    total = X.dbl(F.sum("_total").over(Window.partitionBy()))  # over one row per city
    return cities.select(
        "city",
        "region",
        "active_stores",
        X.dbl("_total").alias("total_revenue"),
        "transaction_count",
        "avg_transaction_value",
        "total_units_sold",
        X.share_pct("_total", total).alias("revenue_share_pct"),
    ).orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("city"))


def top_products(fact: DataFrame, dim_product: DataFrame, k: int = 10) -> DataFrame:
    """Best products by revenue; shares are of all sales, not of the top rows.

    Writes the sums per product when called: the total and the top rows both read them.
    """
    per_key = _first_sums(fact, "product_key").join(
        dim_product.select("product_key", "product_id", F.col("name").alias("product_name"), "category", "brand", "price"),
        "product_key",
    )
    # price is part of the group, so the mean over its rows is the price itself.
    grouped = per_key.groupBy("product_id", "product_name", "category", "brand", "price").agg(
        _units().alias("total_quantity_sold"),
        F.sum("_rev").alias("_total"),
        _n().alias("transaction_count"),
        _mean_revenue().alias("avg_revenue_per_transaction"),
    )
    grouped = stash(grouped, "product-sums")
    total = grouped.agg(X.dbl(F.sum("_total"))).scalar()
    best = top_k(grouped, [F.desc_nulls_last("_total"), F.asc_nulls_last("product_id")], k)
    # At most k rows reach this window.
    rank = Window.orderBy(F.desc_nulls_last("_total"), F.asc_nulls_last("product_id"))
    return best.select(
        "product_id",
        "product_name",
        "category",
        "brand",
        "total_quantity_sold",
        X.dbl("_total").alias("total_revenue"),
        "transaction_count",
        "avg_revenue_per_transaction",
        F.col("price").alias("avg_product_price"),
        X.share_pct("_total", total).alias("revenue_share_pct"),
        F.row_number().over(rank).alias("revenue_rank"),
    ).orderBy("revenue_rank")


def top5_products(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Five best product names by revenue."""
    per_key = _first_sums(fact, "product_key").join(
        dim_product.select("product_key", F.col("name").alias("product_name")), "product_key"
    )
    rows = per_key.groupBy("product_name").agg(_revenue().alias("total_revenue"))
    return top_k(rows, [F.desc_nulls_last("total_revenue"), F.asc_nulls_last("product_name")], 5)


def turnover(fact: DataFrame, dim_product: DataFrame, limit: int | None = None) -> DataFrame:
    """Sales pace per product; ``limit`` gives the short stock-out list. Writes the keys of equal products when called."""
    # One row per product and day first: distinct days become a count, and a hot
    # product shrinks to the length of the calendar.
    group = ["product_id", "product_name", "category", "price"]
    products = dim_product.select("product_key", "product_id", F.col("name").alias("product_name"), "category", "price")
    # Products that share all attributes share a row; their days may overlap. The smallest key stands for
    # them from the start, so that rows per day hold numbers only and attributes come to one row per product.
    named = products.groupBy(*group).agg(F.min("product_key").alias("_of"), F.collect_list("product_key").alias("_keys"))
    shown = named.select("_of", *group)
    others = named.select("_of", F.explode("_keys").alias("product_key")).where("_of <> product_key")
    known = fact.join(stash(others, "same-products"), "product_key", "left").withColumn("_of", F.coalesce("_of", "product_key"))
    rows = _first_sums(known, "_of", "date_key").groupBy("_of").agg(
        _units().alias("total_sold"),
        _revenue().alias("total_revenue"),
        F.count("date_key").alias("days_sold"),
        F.min("date_key").alias("first_sale_date"),
        F.max("date_key").alias("last_sale_date"),
    ).join(shown, "_of")
    pace = X.ratio("total_sold", "days_sold")
    out = rows.withColumn("avg_daily_sales", pace).select(
        "product_id",
        "product_name",
        "category",
        "price",
        "total_sold",
        "total_revenue",
        "days_sold",
        "first_sale_date",
        "last_sale_date",
        "avg_daily_sales",
        (F.col("last_sale_date") - F.col("first_sale_date")).alias("sales_span_days"),
        _days_between("first_sale_date", "last_sale_date").alias("sales_span_true_days"),
        X.movement_category("avg_daily_sales").alias("movement_category"),
        X.round2(F.col("avg_daily_sales") * 30).alias("projected_monthly_sales"),
        X.round2(F.col("avg_daily_sales") * 365).alias("projected_annual_sales"),
    )
    return top_k(out, [F.desc_nulls_last("avg_daily_sales"), F.asc_nulls_last("product_id")], limit)


def delivery_by_month(fact_shipments: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Delivery days per month of shipping.

    Days are whole numbers with few values, so the exact median is taken from
    counts per (month, days) instead of from a sorted list of all deliveries.
    """
    counts = (
        fact_shipments.groupBy("date_key", "delivery_time")
        .agg(F.count("shipment_id").alias("n"), F.count(F.when(F.col("on_time_flag"), 1)).alias("n_on_time"))
        .join(dim_date.select("date_key", "date"), "date_key")
        .groupBy(F.date_trunc("month", "date").cast("timestamp_ntz").alias("delivery_month"), "delivery_time")
        .agg(F.sum("n").alias("n"), F.sum("n_on_time").alias("n_on_time"))
    )
    by_days = Window.partitionBy("delivery_month").orderBy("delivery_time")
    month = Window.partitionBy("delivery_month")
    known = F.when(F.col("delivery_time").isNotNull(), F.col("n")).otherwise(F.lit(0))
    placed = counts.withColumn("upto", F.sum(known).over(by_days)).withColumn("all", F.sum(known).over(month))
    lower, upper = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col("delivery_time")))

    rows = placed.withColumn("lower", lower).withColumn("upper", upper)
    return (
        rows.groupBy("delivery_month")
        .agg(
            F.sum("n").alias("total_deliveries"),
            X.ratio(F.sum(F.col("delivery_time") * known), F.max("all")).alias("avg_delivery_days"),
            F.min("delivery_time").alias("min_delivery_days"),
            F.max("delivery_time").alias("max_delivery_days"),
            ((at(F.col("lower")) + at(F.col("upper"))) / 2).alias("median_delivery_days"),
            X.share_pct(F.sum("n_on_time"), F.sum("n")).alias("on_time_pct"),
        )
        .orderBy(F.desc_nulls_last("delivery_month"))
    )


def top_combos(
    fact: DataFrame, dim_product: DataFrame, dim_store: DataFrame, days: int = 30, k: int = 20, true_days: bool = False
) -> DataFrame:
    """Product and store pairs with the most revenue in the last days."""
    per_key = last_days(fact, days, true_days).groupBy("product_key", "store_key").agg(X.sum_money("revenue").alias("_rev"))
    rows = (
        per_key.join(dim_product.select("product_key", "product_id"), "product_key")
        .join(dim_store.select("store_key", "store_id"), "store_key")
        .groupBy("product_id", "store_id")
        .agg(_revenue().alias("total_revenue"))
    )
    order = [F.desc_nulls_last("total_revenue"), F.asc_nulls_last("product_id"), F.asc_nulls_last("store_id")]
    return top_k(rows, order, k)


# --- customers ----------------------------------------------------------------
def new_vs_returning(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Customers per day, split by whether it was the day of their first purchase."""
    # At most one row per customer and day, so the window below stays within the
    # calendar for any customer. Rows without customer still count as revenue.
    visits = fact.groupBy("customer_key", "date_key").agg(X.sum_money("revenue").alias("_rev"))
    first = Window.partitionBy("customer_key")
    marked = visits.withColumn("_first", F.min("date_key").over(first))
    known = F.col("customer_key").isNotNull()
    per_key = marked.groupBy("date_key").agg(
        F.count("customer_key").alias("total_customers"),
        F.count(F.when(known & (F.col("date_key") == F.col("_first")), 1)).alias("new_customers"),
        F.count(F.when(known & (F.col("date_key") > F.col("_first")), 1)).alias("returning_customers"),
        X.dbl(F.sum("_rev")).alias("total_revenue"),
    )
    return (
        per_key.join(dim_date.select("date_key", "date"), "date_key")
        .select(
            "date",
            "total_customers",
            "new_customers",
            "returning_customers",
            "total_revenue",
            X.share_pct("new_customers", "total_customers").alias("new_customer_pct"),
            X.share_pct("returning_customers", "total_customers").alias("returning_customer_pct"),
        )
        .orderBy(F.desc_nulls_last("date"))
    )


def _customer_sums(fact: DataFrame) -> DataFrame:
    return _first_sums(
        fact, "customer_key", extra=[F.min("date_key").alias("_from"), F.max("date_key").alias("_to")]
    )


def _value_columns() -> list[Column]:
    return [
        _revenue().alias("total_revenue"),
        _n().alias("total_transactions"),
        _mean_revenue().alias("avg_transaction_value"),
        F.min("_from").alias("_from"),
        F.max("_to").alias("_to"),
    ]


def customer_value_by_city(
    fact: DataFrame,
    dim_customer: DataFrame,
    tiers: Mapping[str, Sequence] = S.TIER_CITIES,
    frequency=S.FREQUENCY_LADDER,
    value=S.VALUE_LADDER,
) -> DataFrame:
    joined = _customer_sums(fact).join(dim_customer.select("customer_key", "city"), "customer_key")
    rows = joined.groupBy("city").agg(F.countDistinct("customer_key").alias("customer_count"), *_value_columns())
    return rows.select(
        "city",
        X.city_tier("city", tiers).alias("city_tier"),
        "customer_count",
        "total_revenue",
        F.col("avg_transaction_value").alias("avg_clv"),
        "total_transactions",
        "avg_transaction_value",
        (F.col("_to") - F.col("_from")).alias("customer_lifespan_days"),
        _days_between("_from", "_to").alias("customer_lifespan_true_days"),
        X.frequency_segment("total_transactions", frequency).alias("purchase_frequency_segment"),
        X.value_segment("total_revenue", value).alias("value_segment"),
    ).orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("city"))


def customer_value(
    fact: DataFrame, dim_customer: DataFrame, frequency=S.FREQUENCY_LADDER, value=S.VALUE_LADDER
) -> DataFrame:
    """The same measures and segments per customer, over all versions of the customer."""
    joined = _customer_sums(fact).join(dim_customer.select("customer_key", "customer_id"), "customer_key")
    rows = joined.groupBy("customer_id").agg(*_value_columns())
    return rows.select(
        "customer_id",
        "total_revenue",
        "total_transactions",
        "avg_transaction_value",
        (F.col("_to") - F.col("_from")).alias("customer_lifespan_days"),
        _days_between("_from", "_to").alias("customer_lifespan_true_days"),
        X.frequency_segment("total_transactions", frequency).alias("purchase_frequency_segment"),
        X.value_segment("total_revenue", value).alias("value_segment"),
    ).orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("customer_id"))


# --- headline numbers and chart data -------------------------------------------
def summary(fact: DataFrame) -> DataFrame:
    """Five headline metrics as rows, from one scan."""
    # Each sale gives one row per kind of key; map-side sums shrink them to the distinct keys at once.
    no_money = F.lit(None).cast("decimal(18,4)")
    keys = [
        F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), money.alias("revenue"), sale.alias("sale_id"))
        for kind, key, money, sale in (
            ("customer", "customer_key", X.money("revenue"), F.col("sale_id")),
            ("product", "product_key", no_money, F.lit(None).cast("string")),
            ("store", "store_key", no_money, F.lit(None).cast("string")),
        )
    ]
    return summary_of(fact.select(F.inline(F.array(*keys))).groupBy("kind", "key").agg(F.sum("revenue").alias("_rev"), F.count("sale_id").alias("_n")))


def summary_of(per_key: DataFrame) -> DataFrame:
    """The headline metrics from one row per ``kind`` (customer, product, store) and ``key``; sums of customers only."""

    def known(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("key")))

    one = per_key.agg(
        F.sum("_rev").alias("revenue"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sales"),
        known("customer").alias("customers"),
        known("product").alias("products"),
        known("store").alias("stores"),
    )

    def row(metric: str, column: str, text: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), X.dbl(column).alias("value"), text.alias("formatted_value"))

    rows = F.array(
        row("Total Revenue", "revenue", F.concat(F.lit("₹"), X.money_text("revenue"))),
        row("Total Transactions", "sales", F.col("sales").cast("string")),
        row("Total Customers", "customers", F.col("customers").cast("string")),
        row("Total Products", "products", F.col("products").cast("string")),
        row("Total Stores", "stores", F.col("stores").cast("string")),
    )
    return one.select(F.inline(rows))


def dashboard_cards(fact: DataFrame, dim_date: DataFrame, dim_store: DataFrame, dim_customer: DataFrame, days: int = 30) -> DataFrame:
    """One row of headline cards over the last days, all cities and all customers."""
    recent = recent_daily_revenue(fact, dim_date, days)
    ranked = recent.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("date"))))
    time = ranked.agg(
        F.coalesce(X.dbl(X.sum_money("revenue")), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(X.ratio(X.dbl(X.sum_money("revenue")), F.count(F.lit(1))), F.lit(0.0)).alias("avg_daily_revenue"),
        F.coalesce(F.max(F.when(F.col("_pos") == 1, F.col("revenue"))), F.lit(0.0)).alias("last_revenue"),
        F.coalesce(F.max(F.when(F.col("_pos") == 2, F.col("revenue"))), F.lit(0.0)).alias("prev_revenue"),
    )
    # Stores and customers with sales come from one pass over the fact: both read the same exchange.
    pairs = fact.select("store_key", "customer_key").distinct()
    stores = pairs.select("store_key").distinct().join(dim_store.select("store_key", "city", "region"), "store_key")
    per_city = stores.groupBy("city", "region").agg(F.count("store_key").alias("active_stores"))
    places = per_city.agg(F.struct(F.count(F.lit(1)).alias("cities"), F.coalesce(F.sum("active_stores"), F.lit(0)).alias("stores"))).scalar()
    people = pairs.select("customer_key").distinct().join(dim_customer.select("customer_key"), "customer_key")
    trend = (F.col("last_revenue") - F.col("prev_revenue")) / F.nullif(F.col("prev_revenue"), F.lit(0.0)) * 100
    return time.select(
        "total_revenue",
        "avg_daily_revenue",
        "last_revenue",
        "prev_revenue",
        F.when(F.col("prev_revenue") > 0, trend).otherwise(F.lit(0.0)).alias("revenue_trend_pct"),
        places["cities"].alias("total_cities"),
        places["stores"].alias("total_stores"),
        people.agg(F.count("customer_key")).scalar().alias("total_customers"),
    )


def revenue_chart(fact: DataFrame, dim_date: DataFrame, days: int = 30, shown: int = 10) -> DataFrame:
    """Newest days with their share of the best day and whether they beat the mean day."""
    recent = recent_daily_revenue(fact, dim_date, days)
    # At most `days` rows reach this window.
    everything = Window.partitionBy()
    rows = recent.select(
        "date",
        "revenue",
        (X.ratio("revenue", F.max("revenue").over(everything)) * 100).alias("pct_of_max"),
        (
            F.col("revenue")
            > X.ratio(F.sum(X.money("revenue")).over(everything), F.count(F.lit(1)).over(everything))
        ).alias("is_above_avg"),
    )
    return top_k(rows, [F.desc_nulls_last("date")], shown)


def city_chart(fact: DataFrame, dim_store: DataFrame, shown: int = 8) -> DataFrame:
    """Best cities with their share of the best one."""
    cities = city_sales(fact, dim_store)
    best = F.max("total_revenue").over(Window.partitionBy())  # over one row per city
    rows = cities.select("city", "region", "total_revenue", (X.ratio("total_revenue", best) * 100).alias("pct_of_max"))
    return top_k(rows, [F.desc_nulls_last("total_revenue"), F.asc_nulls_last("city")], shown)


def customer_chart(fact: DataFrame, dim_customer: DataFrame, shown: int = 6) -> DataFrame:
    """Best cities with their share of customers and revenue."""
    cities = customer_value_by_city(fact, dim_customer)
    people = cities.agg(F.sum("customer_count")).scalar()
    total = cities.agg(X.dbl(X.sum_money("total_revenue"))).scalar()
    rows = cities.select(
        "city",
        "city_tier",
        "value_segment",
        "customer_count",
        "total_revenue",
        (X.ratio("customer_count", people) * 100).alias("customer_pct"),
        (X.ratio("total_revenue", total) * 100).alias("revenue_pct"),
    )
    return top_k(rows, [F.desc_nulls_last("total_revenue"), F.asc_nulls_last("city")], shown)
