"""Role views, contract check and table overview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.schemas import WAREHOUSE_CONTRACT

VIEW_NAMES = {
    "analyst": "analyst_sales",
    "store_manager": "store_manager_sales",
    "finance": "finance_sales",
    "admin": "admin_all",
}


def analyst(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Sales with masked phone and email."""
    who = dim_customer.select(
        "customer_key",
        X.mask_phone("phone").alias("phone_masked"),
        X.mask_email("email").alias("email_masked"),
        F.col("city").alias("customer_city"),
    )
    sales = fact.select("sale_id", "date_key", "product_key", "store_key", "quantity", "revenue", "customer_key")
    return sales.join(who, "customer_key").drop("customer_key")


def store_manager(fact: DataFrame, dim_customer: DataFrame, store_key: int | None = None) -> DataFrame:
    """The analyst view, limited to one store when a key is given."""
    rows = analyst(fact, dim_customer)
    return rows if store_key is None else rows.where(F.col("store_key") == store_key)


def finance(fact: DataFrame, dim_customer: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Unmasked sales with product and profit against the list price."""
    who = dim_customer.select("customer_key", F.col("name").alias("customer_name"), "email", "phone", F.col("city").alias("customer_city"))
    what = dim_product.select(
        "product_key",
        F.col("name").alias("product_name"),
        F.col("category").alias("product_category"),
        F.col("price").alias("product_price"),
    )
    joined = fact.join(what, "product_key").join(who, "customer_key")
    profit = X.money("revenue") - X.money("product_price") * F.col("quantity")
    return joined.select(
        *fact.columns,
        "customer_name",
        "email",
        "phone",
        "customer_city",
        "product_name",
        "product_category",
        "product_price",
        profit.alias("profit"),
    )


def admin(fact: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, dim_store: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Rows, key range and revenue per table; what a table lacks is NULL."""
    n = F.count(F.lit(1)).alias("row_count")
    span = [F.min("date_key").alias("min_date_key"), F.max("date_key").alias("max_date_key")]
    parts = [
        ("fact_sales", fact.agg(n, *span, X.dbl(X.sum_money("revenue")).alias("total_revenue"))),
        ("dim_customer", dim_customer.agg(n)),
        ("dim_product", dim_product.agg(n)),
        ("dim_store", dim_store.agg(n)),
        ("dim_date", dim_date.agg(n, *span)),
    ]
    out = None
    for name, rows in parts:
        rows = rows.withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("table_name", "row_count", "min_date_key", "max_date_key", "total_revenue")


def view(role: str, tables: Mapping[str, DataFrame], store_key: int | None = None) -> DataFrame:
    """The rows a role may see."""
    fact, dc = tables["fact_sales"], tables["dim_customer"]
    if role == "analyst":
        return analyst(fact, dc)
    if role == "store_manager":
        return store_manager(fact, dc, store_key)
    if role == "finance":
        return finance(fact, dc, tables["dim_product"])
    if role == "admin":
        return admin(fact, dc, tables["dim_product"], tables["dim_store"], tables["dim_date"])
    raise ValueError(f"unknown role {role!r}")


def create_views(tables: Mapping[str, DataFrame]) -> list[str]:
    """Register all role views; refuses tables that break the contract."""
    broken = contract_violations(next(iter(tables.values())).sparkSession, tables)
    if not broken.isEmpty():
        raise ValueError("the warehouse breaks its contract; see contract_violations()")
    for role, name in VIEW_NAMES.items():
        view(role, tables).createOrReplaceTempView(name)
    return list(VIEW_NAMES.values())


def contract_check(
    spark: SparkSession, tables: Mapping[str, DataFrame], contract: Mapping[str, Sequence[str]] = WAREHOUSE_CONTRACT
) -> DataFrame:
    """(table_name, column_name, present) for each required table ('*') and column."""
    rows = []
    for table, columns in contract.items():
        df = tables.get(table)
        rows.append((table, "*", df is not None))
        rows += [(table, c, df is not None and c in df.columns) for c in columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")


def contract_violations(
    spark: SparkSession, tables: Mapping[str, DataFrame], contract: Mapping[str, Sequence[str]] = WAREHOUSE_CONTRACT
) -> DataFrame:
    return contract_check(spark, tables, contract).where("not present").drop("present")
