"""Live orders as Structured Streaming: ingest, dedup, metrics, alerts, messages.

Sinks are idempotent per micro-batch, so a query restarted from its checkpoint
after a lost executor or driver writes the same result again. Checkpoints and
outputs live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import exprs as X
from shelfline.operators.rows import hot_join, keep_first, salted_join, top_k
from shelfline.session import fresh_path
from shelfline.sources import readers
from shelfline.streaming.partials import disk_state, run_partials


# --- sources and sinks ----------------------------------------------------------
def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` is a folder or a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str = "timestamp") -> DataFrame:
    """Watermarks need a zoned time stamp; the given files carry local ones."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Append everything available to a Parquet table and return the table."""
    spark, folder = stream.sparkSession, fresh_path(stream.sparkSession, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _written(spark, stream.schema, f"{folder}/rows")


def _written(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    """What a stream wrote; no rows if no batch ran."""
    if not readers.path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def run_batches(
    stream: DataFrame,
    label: str,
    write: Callable[[DataFrame, int, str], None],
    output_mode: str = "append",
    watch: Callable[[dict], None] | None = None,
) -> str:
    """Hand every micro-batch to ``write(rows, batch_id, folder)``; returns the folder of the results.

    ``watch`` gets, per batch, the state rows that were ``updated`` and that there are in ``total``.
    """
    folder = fresh_path(stream.sparkSession, label)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch_id: write(rows, batch_id, f"{folder}/rows"))
        .outputMode(output_mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    for progress in query.recentProgress if watch else ():
        if progress.numInputRows:
            watch({"updated": sum(s.numRowsUpdated for s in progress.stateOperators), "total": sum(s.numRowsTotal for s in progress.stateOperators)})
    return f"{folder}/rows"


def _write_batch(rows: DataFrame, batch_id: int, folder: str) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def run_updates(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation in update mode; the newest version of each key is its result.

    Unlike append mode this includes windows that the watermark has not closed yet.
    """
    folder = run_batches(stream, label, _write_batch, "update")
    schema = T.StructType(stream.schema.fields + [T.StructField("batch_id", T.LongType())])
    versions = _written(stream.sparkSession, schema, folder)
    return keep_first(versions, keys, [F.desc("batch_id")]).drop("batch_id")


# --- transformations ---------------------------------------------------------------
def dedup(orders: DataFrame, delay: str) -> DataFrame:
    """One row per order id while rows keep within ``delay``: later ones are dropped (``run_dedup`` drops none)."""
    return orders.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["order_id"])


def daily_metrics(orders: DataFrame, delay: str) -> DataFrame:
    """Orders, revenue, mean order and approximate customers per day (UTC days, in a UTC session).

    A running view: rows later than ``delay`` are dropped, which ``run_daily_metrics`` avoids.
    """
    amount = X.money("price") * F.col("quantity")
    return (
        orders.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(amount).alias("_revenue"),
            F.approx_count_distinct("customer_id").alias("approx_customers"),
        )
        .select(
            F.to_date("w.start").alias("day"),
            "orders",
            X.dbl("_revenue").alias("revenue"),
            X.ratio("_revenue", "orders").alias("avg_order_value"),
            "approx_customers",
        )
    )


def metrics_by_day(orders: DataFrame) -> DataFrame:
    """The same per day of an order table, with exact customers."""
    amount = X.money("price") * F.col("quantity")
    # One row per day and customer first, so that distinct customers are a count of rows.
    return _days(orders.groupBy(F.to_date("timestamp").alias("day"), "customer_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_revenue")))


def _days(each: DataFrame) -> DataFrame:
    """Day rows from sums per day and customer."""
    return each.groupBy("day").agg(
        F.sum("_n").alias("orders"),
        X.dbl(F.sum("_revenue")).alias("revenue"),
        X.ratio(F.sum("_revenue"), F.sum("_n")).alias("avg_order_value"),
        F.count("customer_id").alias("unique_customers"),
    )


def run_daily_metrics(stream: DataFrame, label: str) -> DataFrame:
    """``metrics_by_day`` of a stream. A batch adds its sums per day and customer; no order is too late to count."""
    amount = X.money("price") * F.col("quantity")
    source = stream.select(F.to_date("timestamp").alias("day"), "customer_id", F.lit(1).alias("_n"), amount.alias("_revenue"))
    partials, batches = run_partials(source, fresh_path(stream.sparkSession, label), ["day", "customer_id"])
    return _days(partials.state(stream.sparkSession, batches))


def run_dedup(stream: DataFrame, label: str, watch: Callable[[dict], None] | None = None) -> DataFrame:
    """One row per order id over all micro-batches, however far apart the repeats are.

    Keyed state on disk holds the row kept of each id: the smallest one (nulls last) of the first batch
    that had the id, by the time of the batch, which a repeated batch has again. A
    batch looks up its own ids only and writes those that are new into its own folder.
    """
    spark, schema = stream.sparkSession, stream.schema
    rank = [field for c in stream.columns for field in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = F.min(F.struct("_at", *rank)).alias("_first")
    state = stream.withColumn("_at", F.current_timestamp()).groupBy(F.col("order_id").alias("_id")).agg(first, F.max("_at").alias("_last"))

    def add(rows: DataFrame, batch_id: int, folder: str) -> None:
        new = rows.where(F.col("_first._at") == F.col("_last"))
        _write_batch(new.select(*(F.col("_first")[c].alias(c) for c in schema.names)), batch_id, folder)

    with disk_state(spark):
        folder = run_batches(state, label, add, "update", watch)
    return _written(spark, T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())]), folder).drop("batch_id")


def run_quarantine_rate(stream: DataFrame, label: str, minutes: int = 30, threshold: int = 100) -> DataFrame:
    """Windows of a log, whatever order its rows come in; a batch adds its counts per window."""
    source = stream.select(F.window("timestamp", f"{minutes} minutes")["start"].alias("start"), F.lit(1).alias("issue_count"))
    partials, batches = run_partials(source, fresh_path(stream.sparkSession, label), ["start"])
    counts = partials.state(stream.sparkSession, batches)
    return counts.select(F.col("start").cast("timestamp_ntz").alias("window_start"), "issue_count", (F.col("issue_count") > threshold).alias("is_high"))


def day_metrics(orders: DataFrame, day: Column) -> DataFrame:
    """The same numbers for one day of the order table, with exact customers; zeros for an empty day."""
    amount = X.money("price") * F.col("quantity")
    today = orders.where(F.to_date("timestamp") == day)
    return today.agg(
        F.count(F.lit(1)).alias("orders_today"),
        F.coalesce(X.dbl(F.sum(amount)), F.lit(0.0)).alias("revenue_today"),
        F.coalesce(X.ratio(F.sum(amount), F.count(amount)), F.lit(0.0)).alias("avg_order_value"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def live_totals(orders: DataFrame, day: Column) -> DataFrame:
    """Orders of all time and revenue of one day, in one pass."""
    amount = X.money("price") * F.col("quantity")
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(X.dbl(F.sum(F.when(F.to_date("timestamp") == day, amount))), F.lit(0.0)).alias("revenue_today"),
    )


def _newest() -> list[Column]:
    return [F.desc_nulls_last("timestamp"), F.desc_nulls_last("order_id")]


def recent(orders: DataFrame, k: int = 10) -> DataFrame:
    """The newest orders of a table."""
    return top_k(orders, _newest(), k)


def run_recent(stream: DataFrame, label: str, k: int = 50) -> DataFrame:
    """Keep the newest ``k`` orders over all micro-batches.

    Each batch writes the newest of its rows and those kept before to its own
    folder, so a repeated batch gives the same folder again.
    """
    spark, schema = stream.sparkSession, stream.schema

    def keep(rows: DataFrame, batch_id: int, folder: str) -> None:
        if batch_id > 0:
            before = rows.sparkSession.read.schema(schema).parquet(f"{folder}/batch_id={batch_id - 1}")
            rows = rows.unionByName(before)
        _write_batch(recent(rows, k), batch_id, folder)

    folder = run_batches(stream, label, keep)
    kept = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    versions = _written(spark, kept, folder)
    last = versions.agg(F.max("batch_id")).scalar()
    return recent(versions.where(F.col("batch_id") == last).drop("batch_id"), k)


def _risky(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("risk_level").isin("High", "Critical")).select(
        "product_id",
        "store_id",
        "risk_level",
        F.col("ml_confidence").alias("confidence"),
        "recommended_reorder",
    )


_ALERT = ["order_id", "timestamp", "product_id", "store_id", "risk_level", "confidence", "recommended_reorder"]


def alerts(orders: DataFrame, scores: DataFrame, salts: int = 16) -> DataFrame:
    """Orders of pairs whose score is High or Critical, as alerts.

    scores: product_id, store_id, risk_level, ml_confidence, recommended_reorder.
    Adaptive skew handling is off in streams, so a pair with most of the orders is
    spread by a salt; ``run_alerts`` salts only the pairs that a batch shows to be hot.
    """
    return salted_join(orders.select(*_ALERT[:4]), _risky(scores), ["product_id", "store_id"], salts).select(*_ALERT)


def batch_alerts(orders: DataFrame, scores: DataFrame, share: int = 100_000) -> DataFrame:
    """The same of one batch; scores are repeated only for pairs with more than ``share`` of its orders."""
    return hot_join(orders.select(*_ALERT[:4]), _risky(scores), ["product_id", "store_id"], share).select(*_ALERT)


def _run_joined(stream: DataFrame, label: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of every micro-batch, which may read the batch more than once, in one folder per batch."""

    def add(rows: DataFrame, batch_id: int, folder: str) -> None:
        rows = rows.persist()
        try:
            _write_batch(made(rows), batch_id, folder)
        finally:
            rows.unpersist()

    folder = run_batches(stream, label, add)
    schema = made(stream.sparkSession.createDataFrame([], stream.schema)).schema
    return _written(stream.sparkSession, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]), folder).drop("batch_id")


def run_alerts(stream: DataFrame, scores: DataFrame, label: str, share: int = 100_000) -> DataFrame:
    """Alerts of everything available of a stream."""
    return _run_joined(stream, label, lambda orders: batch_alerts(orders, scores, share))


def run_messages(stream: DataFrame, scores: DataFrame, label: str, share: int = 100_000) -> DataFrame:
    """Order and alert messages of everything available of a stream."""
    return _run_joined(stream, label, lambda orders: order_messages(orders).unionByName(alert_messages(batch_alerts(orders, scores, share))))


def order_messages(orders: DataFrame) -> DataFrame:
    body = F.struct(F.lit("order").alias("type"), "order_id", "product_id", "store_id", "price")
    return orders.select(F.to_json(body).alias("value"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit("ml_alert").alias("type"),
        "product_id",
        "store_id",
        "risk_level",
        "confidence",
        F.col("recommended_reorder").alias("reorder"),
    )
    return alerts.select(F.to_json(body).alias("value"))


def messages(orders: DataFrame, scores: DataFrame, salts: int = 16) -> DataFrame:
    """Order and alert messages for clients, one JSON text per row."""
    return order_messages(orders).unionByName(alert_messages(alerts(orders, scores, salts)))


def quarantine_rate(log: DataFrame, delay: str, minutes: int = 30, threshold: int = 100) -> DataFrame:
    """Half-hour windows with their number of quarantined rows and whether that is too many.

    A running view: rows later than ``delay`` are dropped, which ``run_quarantine_rate`` avoids.
    """
    return (
        log.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("issue_count"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            "issue_count",
            (F.col("issue_count") > threshold).alias("is_high"),
        )
    )
