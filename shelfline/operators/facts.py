"""Fact tables: foreign keys resolved by inner joins, unresolvable rows dropped.

No side is broadcast by hint. Dimensions under the broadcast threshold are
broadcast by Spark from their measured size; larger ones are sort-merge joined,
where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import schemas as S
from shelfline.functions import exprs as X


def fact_sales(
    transactions: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, dim_store: DataFrame, dim_date: DataFrame
) -> DataFrame:
    """One row per cleaned sales line with all keys resolved; money stays exact."""
    # Plain null tests, not dropna: these reach the Parquet scan as pushed filters.
    t = transactions
    for name in ("customer_id", "product_id", "store_id", "date"):
        t = t.where(F.col(name).isNotNull())
    discount = F.coalesce(X.money("discount"), F.lit(0).cast(S.MONEY))
    t = t.select(
        F.col("transaction_id").alias("sale_id"),
        "customer_id",
        "product_id",
        "store_id",
        F.to_date("date").alias("date"),
        F.col("quantity").cast("int").alias("quantity"),
        (F.col("quantity").cast("int") * X.money("price") - discount).cast(S.MONEY).alias("revenue"),
        discount.alias("discount"),
    )
    current = dim_customer.where("is_current").select("customer_id", "customer_key")
    return (
        t.join(dim_date.select("date", "date_key"), "date")
        .join(dim_store.select("store_id", "store_key"), "store_id")
        .join(dim_product.select("product_id", "product_key"), "product_id")
        .join(current, "customer_id")
        .select("sale_id", "date_key", "customer_key", "product_key", "store_key", "quantity", "revenue", "discount")
    )


def resolve_inventory(inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Inventory with keys looked up; a key stays NULL when its id is unknown."""
    return inventory.join(dim_product.select("product_id", "product_key"), "product_id", "left").join(
        dim_store.select("store_id", "store_key"), "store_id", "left"
    )


def fact_inventory(
    inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame, reorder_point: int = S.DEFAULT_REORDER_POINT
) -> DataFrame:
    resolved = resolve_inventory(inventory, dim_product, dim_store)
    known = resolved.where(F.col("product_key").isNotNull() & F.col("store_key").isNotNull())
    return known.select(
        F.lit(None).cast("long").alias("inventory_id"),
        X.date_key("date").alias("date_key"),
        "product_key",
        "store_key",
        F.col("stock_level").cast("int").alias("stock_level"),
        F.lit(reorder_point).alias("reorder_point"),
    )


def inventory_load_counts(inventory: DataFrame, dim_product: DataFrame, dim_store: DataFrame) -> DataFrame:
    """How many stock counts were read, loaded and dropped for unknown ids."""
    known = F.col("product_key").isNotNull() & F.col("store_key").isNotNull()
    return resolve_inventory(inventory, dim_product, dim_store).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(known, 1)).alias("rows_loaded"),
        F.count(F.when(~known, 1)).alias("rows_dropped"),
    )


def fact_shipments(shipments: DataFrame, fact_sales: DataFrame, on_time_days: int = 5) -> DataFrame:
    """Shipments of known sales: days from shipping to delivery, and whether that was on time."""
    days = F.datediff("delivery_date", "ship_date")
    return (
        shipments.join(
            fact_sales.select(F.col("sale_id").alias("transaction_id"), "product_key", "store_key"), "transaction_id"
        )
        .select(
            "shipment_id",
            X.date_key("ship_date").alias("date_key"),
            "product_key",
            "store_key",
            days.cast("double").alias("delivery_time"),
            (days <= on_time_days).alias("on_time_flag"),
        )
    )


def last_days(fact: DataFrame, days: int, true_days: bool = False) -> DataFrame:
    """Rows of the last days before the newest one.

    By default the window is counted on the ``yyyymmdd`` number, which reaches
    further back across month ends; ``true_days`` counts calendar days.
    """
    newest = fact.agg(F.max("date_key"))
    if not true_days:
        return fact.where(F.col("date_key") >= newest.scalar() - days)
    first: Column = X.date_key(F.date_sub(X.key_to_date(newest.scalar()), days))
    return fact.where(F.col("date_key") >= first)
