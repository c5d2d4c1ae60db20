"""The given order tables seen as retail input tables.

Every function derives one raw retail table from the Parquet files in ``sf_dir``.
``lines`` takes order lines that are joined already. Data defects (negative prices, missing ids, future dates, ...) are put in by key
arithmetic, so that cleaning and validation have something to find in any data
size, and so that the same rows can be derived by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import exprs as X

# --- fixed values ---------------------------------------------------------
CITIES = [
    "Mumbai", "Delhi", "Bangalore", "Chennai", "Kolkata",
    "Pune", "Hyderabad", "Ahmedabad", "Jaipur", "Surat",
]
# Nations from this key on keep their own name as city (region and tier unknown).
FIRST_UNMAPPED_NATION = 20
AS_OF = "2002-01-01 00:00:00"
STREAM_AS_OF = "2024-01-31 00:00:00"
# --------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.to_timestamp_ntz(F.lit(text))


def _city(nation_key, nation_name):
    names = F.array(*[F.lit(c) for c in CITIES])
    return F.when(nation_key >= FIRST_UNMAPPED_NATION, nation_name).otherwise(
        F.element_at(names, (nation_key % len(CITIES) + 1).cast("int"))
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey").cast("string")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("C"), key).alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user"), key, F.lit("@mail"), F.col("c_nationkey").cast("string"), F.lit(".example.com")).alias("email"),
        F.when(F.col("c_custkey") % 50 == 7, F.lit(None))
        .otherwise(F.concat(F.lit("+91-"), (F.col("c_custkey") + 9000000000).cast("string")))
        .alias("phone"),
        _city(F.col("c_nationkey"), F.col("n_name")).alias("city"),
        F.col("c_acctbal").alias("balance"),
    )


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later customer extract: some customers have moved to Pune."""
    return customers(spark, sf_dir).withColumn(
        "city", F.when(F.substring("customer_id", -1, 1) == "3", F.lit("Pune")).otherwise(F.col("city"))
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("base_price"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("store_id"),
        F.col("s_name").alias("store_name"),
        _city(F.col("s_nationkey"), F.col("n_name")).alias("city"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order. The orders of a task are hashed: a sort of all lines would not pay, as cleaning sorts them anyway."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey)


def transactions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, with_order: bool = False) -> DataFrame:
    """Raw sales lines with defects; ``transaction_id`` repeats in the source itself.

    ``with_order`` adds ``order_key``, by which the join of order lines has dealt them.
    """
    order = F.col("l_orderkey")
    price, discount = X.money("l_extendedprice"), F.col("l_discount")
    return (order_lines(spark, sf_dir) if lines is None else lines).select(
        F.concat(order.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.when(order % 300 == 11, F.col("o_orderdate") + F.expr("INTERVAL '3650' DAY"))
        .otherwise(F.col("o_orderdate"))
        .alias("date"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("store_id"),
        F.when(order % 100 != 7, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("customer_id"),
        F.when(order % 500 != 9, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("product_id"),
        F.when(order % 250 == 3, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.when(order % 200 == 0, -price).otherwise(price).alias("price"),
        F.when(discount != 0, X.money(F.round(F.col("l_extendedprice").cast("decimal(18,2)") * discount.cast("decimal(4,2)"), 2)))
        .alias("discount"),
        F.col("o_orderpriority").alias("payment_method"),
        *([order.alias("order_key")] if with_order else []),
    )


# Total order among repeats of one transaction_id; what still ties is identical.
TRANSACTION_ORDER = ["product_id", "store_id", "quantity", "price", "discount"]


def transaction_order():
    return [F.col(c).asc_nulls_last() for c in TRANSACTION_ORDER]


def inventory(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """A stock count for each store, product and day with a sale; some products are unknown."""
    part, day = F.col("l_partkey"), F.to_date("o_orderdate")
    product = F.when(part % 211 == 5, F.concat(F.lit("X"), part.cast("string"))).otherwise(
        F.concat(F.lit("P"), part.cast("string"))
    )
    return (
        (order_lines(spark, sf_dir) if lines is None else lines)
        .select("l_suppkey", "l_partkey", day.alias("day"))
        .distinct()
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("store_id"),
            product.alias("product_id"),
            F.col("day").alias("date"),
            ((part * 7 + F.col("l_suppkey") * 3 + F.unix_date("day")) % 100).cast("int").alias("stock_level"),
        )
    )


def shipments(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One shipment per sales line: shipped the next day, 1 to 10 days on the road."""
    days = F.lit(1) + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10
    shipped = F.date_add(F.to_date("o_orderdate"), 1)
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    return (
        (order_lines(spark, sf_dir) if lines is None else lines)
        .select("l_orderkey", "l_linenumber", "o_orderdate")
        .distinct()
        .select(
            F.concat(F.lit("SHP"), order, F.lit("-"), line).alias("shipment_id"),
            F.concat(order, F.lit("-"), line).alias("transaction_id"),
            shipped.alias("ship_date"),
            F.date_add(shipped, days.cast("int")).alias("delivery_date"),
        )
    )


def live_orders(events: DataFrame) -> DataFrame:
    """Purchase events as live orders; works on a batch or a streaming frame."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("store_id"),
        (F.col("user_id") % 3 + 1).cast("int").alias("quantity"),
        F.col("value").alias("price"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("customer_id"),
    )


def quarantine_events(events: DataFrame) -> DataFrame:
    """Error events as entries of a quarantine log."""
    return events.where("event_type = 'error'").select(
        F.col("ts").alias("timestamp"), F.lit("transactions").alias("table_name"), F.col("value"), F.col("event_id")
    )


def batch_runs(events: DataFrame) -> DataFrame:
    """Ingest runs seen in the event log: one per day and event type."""
    return (
        events.groupBy(F.to_date("ts").alias("day"), F.col("event_type"))
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("rows_processed"),
            F.count(F.when(F.col("value") > 100, 1)).alias("rows_quarantined"),
        )
        .select(
            F.concat_ws(":", F.lit("ingest"), "event_type").alias("run_name"),
            "start_time",
            "end_time",
            "rows_processed",
            "rows_quarantined",
        )
    )
