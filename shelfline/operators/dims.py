"""Dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas as S
from shelfline.functions import exprs as X
from shelfline.operators.rows import dense_keys

CUSTOMER_COLUMNS = [
    "customer_key", "customer_id", "name", "email", "phone", "city",
    "valid_from", "valid_to", "is_current", "version",
]


def _calendar(bounds: DataFrame) -> DataFrame:
    """Calendar rows from one (first, last) row."""
    days = bounds.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(
        X.date_key("date").alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        X.is_weekend("date").alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.lit(None).cast("string").alias("festival_name"),
    )


def dim_date(spark: SparkSession, start: str = "2024-01-01", end: str = "2024-12-31") -> DataFrame:
    """Calendar for a given range (both ends included)."""
    return _calendar(spark.range(1).select(F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last")))


def dim_date_covering(df: DataFrame, column: str) -> DataFrame:
    """Calendar from the first to the last day found in a column."""
    return _calendar(df.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last")))


def _versioned(df: DataFrame, as_of: Column, version: Column) -> DataFrame:
    return df.select(
        "customer_id",
        "name",
        "email",
        "phone",
        "city",
        as_of.alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
        version.cast("int").alias("version"),
    )


def dim_customer(customers: DataFrame, as_of: Column) -> DataFrame:
    """First load: every customer as version 1."""
    return dense_keys(_versioned(customers, as_of, F.lit(1)), ["customer_id"], "customer_key").select(*CUSTOMER_COLUMNS)


def next_key(dim: DataFrame, key: str) -> Column:
    """Greatest key so far, 0 for an empty table."""
    return dim.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()


def new_customers(dim: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """Customers of a snapshot that have no row yet, as version 1 with the next free keys."""
    collapsed = snapshot.groupBy("customer_id").agg(
        *[F.min(c).alias(c) for c in ("name", "email", "phone", "city")]
    )
    fresh = collapsed.join(dim.select("customer_id"), "customer_id", "left_anti")
    rows = _versioned(fresh, as_of, F.lit(1))
    return dense_keys(rows, ["customer_id"], "customer_key", next_key(dim, "customer_key")).select(*CUSTOMER_COLUMNS)


def insert_new(dim: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """The dimension plus the customers it lacked; existing rows stay as they are."""
    return dim.select(*CUSTOMER_COLUMNS).unionByName(new_customers(dim, snapshot, as_of))


def dim_product(products: DataFrame) -> DataFrame:
    brand = F.col("brand") if "brand" in products.columns else F.lit(None).cast("string")
    rows = products.select(
        "product_id",
        F.col("product_name").alias("name"),
        "category",
        brand.alias("brand"),
        F.col("base_price").cast("double").alias("price"),
    )
    return dense_keys(rows, ["product_id"], "product_key")


def dim_store(stores: DataFrame, mapping: Mapping[str, Sequence] = S.REGION_CITIES) -> DataFrame:
    rows = stores.select("store_id", "store_name", "city", X.region("city", mapping).alias("region"))
    return dense_keys(rows, ["store_id"], "store_key")


def store_counts_by_region(dim_store: DataFrame) -> DataFrame:
    return dim_store.groupBy("region").agg(F.count(F.lit(1)).alias("store_count")).orderBy(F.asc_nulls_last("region"))


def regions(dim_store: DataFrame) -> DataFrame:
    return dim_store.select("region").distinct().orderBy(F.asc_nulls_last("region"))
