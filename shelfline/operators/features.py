"""Stock-out features and labels per product and store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfline.functions import exprs as X
from shelfline.operators.rows import keep_first

PAIR = ["product_id", "store_id"]
FEATURES = ["current_stock", "avg_sales_7d", "stddev_sales_7d", "category_encoded"]
DAYS = 7


def trailing_sales(daily: DataFrame, days: int = DAYS, keep: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of units over the last ``days`` days; days without a sale count as 0.

    ``daily`` has one row per pair and day, so a pair's window is at most as long
    as the calendar however many sales it has. Columns of ``keep`` stay.
    """
    w = Window.partitionBy(*PAIR).orderBy("day_number").rangeBetween(-(days - 1), 0)
    units = F.col("units").cast("long")
    rows = (
        daily.withColumn("day_number", F.unix_date("date"))
        .withColumn("_sum", F.sum(units).over(w))
        .withColumn("_sumsq", F.sum(units * units).over(w))
    )
    # Sample variance from integer sums: (n*sum(x^2) - sum(x)^2) / (n*(n-1)).
    variance = X.ratio(F.lit(days) * F.col("_sumsq") - F.col("_sum") * F.col("_sum"), F.lit(days * (days - 1)))
    return rows.select(
        *PAIR,
        "date",
        (X.dbl("_sum") / days).alias("avg_sales_7d"),
        F.round(F.sqrt(variance), 6).alias("stddev_sales_7d"),
        *keep,
    )


def trailing_at(daily: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """Mean and deviation per pair over the ``days`` days up to ``as_of``; pairs without a sale in them are absent."""
    units = F.col("units").cast("long")
    recent = daily.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(as_of, days)))
    sums = recent.groupBy(*PAIR).agg(F.sum(units).alias("_sum"), F.sum(units * units).alias("_sumsq"))
    variance = X.ratio(F.lit(days) * F.col("_sumsq") - F.col("_sum") * F.col("_sum"), F.lit(days * (days - 1)))
    return sums.select(*PAIR, (X.dbl("_sum") / days).alias("avg_sales_7d"), F.round(F.sqrt(variance), 6).alias("stddev_sales_7d"))


def daily_units(fact_sales: DataFrame, dim_product: DataFrame, dim_store: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Units per product, store and day of the fact, by business id.

    Nearly every sale has a product, store and day of its own, so sums by key first would only be one more shuffle;
    partial sums keep a hot pair small all the same.
    """
    rows = fact_sales.select("product_key", "store_key", "date_key", F.col("quantity").cast("bigint").alias("units"))
    return _named(rows, dim_product, dim_store, dim_date).groupBy(*PAIR, "date").agg(F.sum("units").alias("units"))


def stock_counts(fact_inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Stock counts by business id and date."""
    rows = fact_inventory.select("product_key", "store_key", "date_key", "stock_level")
    return _named(rows, dim_product, dim_store, dim_date).select(*PAIR, "date", "stock_level")


def _named(rows: DataFrame, dim_product: DataFrame, dim_store: DataFrame, dim_date: DataFrame) -> DataFrame:
    return (
        rows.join(dim_product.select("product_key", "product_id"), "product_key")
        .join(dim_store.select("store_key", "store_id"), "store_key")
        .join(dim_date.select("date_key", "date"), "date_key")
    )


def latest_stock(stock: DataFrame) -> DataFrame:
    """Newest stock count per pair."""
    newest = keep_first(stock, PAIR, [F.desc_nulls_last("date"), F.desc_nulls_last("stock_level")])
    return newest.select(*PAIR, F.col("stock_level").cast("double").alias("current_stock"))


def category_codes(categories: DataFrame) -> DataFrame:
    """(category, category_encoded): 0, 1, 2, ... in alphabetical order."""
    distinct = categories.select("category").dropna().distinct()
    # One row per category reaches this window.
    place = F.row_number().over(Window.orderBy("category"))
    return distinct.withColumn("category_encoded", (place - 1).cast("int"))


def _coded(categories: DataFrame) -> DataFrame:
    return categories.join(category_codes(categories), "category").select("product_id", "category_encoded")


def stock_features(daily: DataFrame, stock: DataFrame, categories: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """One row per stocked pair: newest stock, sales over the days up to ``as_of`` (0 for idle pairs), category code.

    daily: product_id, store_id, date, units (one row per pair and day);
    stock: product_id, store_id, date, stock_level; categories: product_id, category.
    """
    sold = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_sales_7d", "stddev_sales_7d")]
    described = latest_stock(stock).join(trailing_at(daily, as_of, days), PAIR, "left").join(_coded(categories), "product_id")
    return described.select(*PAIR, "current_stock", *sold, "category_encoded")


def history_features(daily: DataFrame, stock: DataFrame, categories: DataFrame, days: int = DAYS) -> DataFrame:
    """The same features on every day with a stock count: what the models learn from.

    Sales and counts are dealt by pair together, once: both meet per day, and the trailing days, where they are.
    A counted day without sales has means of 0.
    """
    key = [*PAIR, "date"]
    sold = daily.select(*key, F.col("units").cast("long").alias("units"), F.lit(True).alias("_sold"), F.lit(None).cast("double").alias("current_stock"), F.lit(None).cast("boolean").alias("_counted"))
    counted = stock.select(*key, F.lit(None).cast("long").alias("units"), F.lit(None).cast("boolean").alias("_sold"), F.col("stock_level").cast("double").alias("current_stock"), F.lit(True).alias("_counted"))
    days_of = sold.unionByName(counted).repartition(*PAIR).groupBy(*key).agg(
        F.sum("units").alias("units"), F.max("_sold").alias("_sold"), F.max("current_stock").alias("current_stock"), F.max("_counted").alias("_counted")
    )
    shown = trailing_sales(days_of, days, ["_sold", "current_stock", "_counted"]).where("_counted")
    shown = shown.withColumns({c: F.when(F.col("_sold"), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)) for c in ("avg_sales_7d", "stddev_sales_7d")})
    return shown.join(_coded(categories), "product_id").select(*key, *FEATURES)


def with_labels(features: DataFrame) -> DataFrame:
    """risk = stock below a week's mean day; reorder_qty = two mean days less stock, not below 0."""
    stock, mean = F.col("current_stock"), F.col("avg_sales_7d")
    return features.withColumn("risk", (stock < mean).cast("int")).withColumn(
        "reorder_qty", F.greatest(mean * 2 - stock, F.lit(0.0))
    )


def known_pairs(inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Distinct pairs of raw stock counts whose ids both dimensions know; the counts themselves are not joined."""
    pairs = inventory.select(*PAIR).distinct()
    return pairs.join(dim_product.select("product_id"), "product_id", "left_semi").join(dim_store.select("store_id"), "store_id", "left_semi").select(*PAIR)


def stocked_pairs(fact_inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Distinct product and store ids that have a stock count."""
    keys = fact_inventory.select("product_key", "store_key").distinct()
    return (
        keys.join(dim_product.select("product_key", "product_id"), "product_key")
        .join(dim_store.select("store_key", "store_id"), "store_key")
        .select(*PAIR)
        .distinct()
    )
