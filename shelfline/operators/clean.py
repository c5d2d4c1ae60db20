"""Rule-based cleaning of transactions, in the fixed order of seven steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import exprs as X
from shelfline.operators.rows import keep_first
from shelfline.session import stash

CRITICAL = ["transaction_id", "product_id", "store_id"]
SIGMAS = 3
KEY = ("transaction_id",)


def _prepared(df: DataFrame, order_by: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """Step 1 (one row per transaction) with discount, date and the step flags alongside.

    Each ``_bad_*`` flag is true for rows that its step removes; a row belongs to
    the first step whose flag is set. ``key`` may name columns that follow from the transaction id, too:
    rows that are dealt by one of them already are not shuffled again. They are dropped.
    """
    kept = keep_first(df, key, order_by).drop(*(c for c in key if c not in KEY))
    if "discount" not in kept.columns:
        kept = kept.withColumn("discount", F.lit(0).cast("double"))
        kept = kept.withColumn("_no_discount", F.lit(False))
    else:
        kept = kept.withColumn("_no_discount", F.col("discount").isNull())
        zero = F.lit(0).cast(kept.schema["discount"].dataType)
        kept = kept.withColumn("discount", F.coalesce("discount", zero))
    if isinstance(kept.schema["date"].dataType, T.StringType):
        kept = kept.withColumn("date", F.try_to_timestamp("date").cast("timestamp_ntz"))
    critical = F.lit(False)
    for name in CRITICAL:
        critical = critical | F.col(name).isNull()
    return kept.withColumn("_bad_critical", critical).withColumn(
        "_bad_quantity", ~F.coalesce(F.col("quantity") > 0, F.lit(False))
    )


def _late(as_of: Column) -> Column:
    return ~F.coalesce(F.col("date") <= as_of, F.lit(False))


def clean_rows(df: DataFrame, as_of: Column, order_by: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """Steps 1 to 6: dedup, fill discounts, drop incomplete, fix prices, drop bad quantities and dates."""
    rows = _prepared(df, order_by, key)
    kept = rows.where(~F.col("_bad_critical") & ~F.col("_bad_quantity") & ~_late(as_of))
    return kept.withColumn("price", F.abs("price")).drop("_no_discount", "_bad_critical", "_bad_quantity")


def price_threshold(cleaned: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """One row: mean, sample standard deviation and the anomaly threshold."""
    price = X.dbl("price")
    stats = cleaned.agg(
        X.ratio(X.sum_money("price"), F.count("price")).alias("mean_price"), F.stddev_samp(price).alias("std_price")
    )
    return stats.withColumn("threshold", F.col("mean_price") + sigmas * F.col("std_price"))


def flag_anomalies(cleaned: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """Step 7: mark prices above mean + 3 standard deviations, keep the rows."""
    limit = price_threshold(cleaned, sigmas).select("threshold").scalar()
    return cleaned.withColumn("is_anomaly", F.coalesce(X.dbl("price") > limit, F.lit(False)))


def clean(df: DataFrame, as_of: Column, order_by: Sequence[Column]) -> DataFrame:
    """All seven steps. Steps 1 to 6 are written once: step 7 reads their rows twice."""
    return flag_anomalies(stash(clean_rows(df, as_of, order_by), "cleaned"))


def report(df: DataFrame, as_of: Column, order_by: Sequence[Column]) -> DataFrame:
    """One row with the count of every step, rows removed and retention in percent.

    The deduplicated rows are written once, narrowed to what the counts need.
    """
    needed = ["date", "quantity", "price", "_no_discount", "_bad_critical", "_bad_quantity"]
    rows = stash(_prepared(df, order_by).select(*needed), "clean-report")
    critical, quantity = F.col("_bad_critical"), F.col("_bad_quantity")
    late = _late(as_of)

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    steps = rows.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        n(F.col("_no_discount")).alias("nulls_fixed"),
        n(critical).alias("critical_rows_removed"),
        n(~critical & (F.col("price") < 0)).alias("invalid_values_fixed"),
        n(~critical & quantity).alias("invalid_quantity_removed"),
        n(~critical & ~quantity & late).alias("future_rows_removed"),
        n(~critical & ~quantity & ~late).alias("final_rows"),
    )
    initial = df.agg(F.count(F.lit(1))).scalar()
    kept = rows.where(~critical & ~quantity & ~late).withColumn("price", F.abs("price"))
    anomalies = flag_anomalies(kept).agg(F.count(F.when(F.col("is_anomaly"), 1))).scalar()
    counted = steps.select("*", initial.alias("initial_rows"), anomalies.alias("anomalies_flagged"))
    return counted.select(
        "initial_rows",
        (F.col("initial_rows") - F.col("unique_rows")).alias("duplicates_removed"),
        "nulls_fixed",
        "critical_rows_removed",
        "invalid_values_fixed",
        "invalid_quantity_removed",
        "future_rows_removed",
        "anomalies_flagged",
        "final_rows",
        (F.col("initial_rows") - F.col("final_rows")).alias("rows_removed"),
        X.share_pct("final_rows", "initial_rows").alias("retention_pct"),
    )
