"""Seven-day demand forecast: mean per weekday over the last weeks, with bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators.features import PAIR

WEEKS = 8
Z = 1.96
HORIZON = 7


def weekday_profile(daily: DataFrame, as_of: Column, weeks: int = WEEKS) -> DataFrame:
    """Per pair and weekday: mean and variance of units over the last ``weeks`` weeks, empty days as 0.

    Built from integer sums, so partial sums can be added in any order.
    """
    recent = daily.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(as_of, weeks * 7)))
    units = F.col("units").cast("long")
    sums = recent.groupBy(*PAIR, F.dayofweek("date").alias("weekday")).agg(
        F.sum(units).alias("_sum"), F.sum(units * units).alias("_sumsq")
    )
    spread = X.ratio(F.lit(weeks) * F.col("_sumsq") - F.col("_sum") * F.col("_sum"), F.lit(weeks * (weeks - 1)))
    return sums.select(*PAIR, "weekday", (X.dbl("_sum") / weeks).alias("mean"), spread.alias("variance"))


def with_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Each distinct pair with what is known of it, if anything. ``known``, few rows beside all pairs, is hashed, so that pairs need no sort."""
    return pairs.select(*PAIR).distinct().join(known.hint("shuffle_hash"), PAIR, "left")


def daily_forecast(daily: DataFrame, pairs: DataFrame, as_of: Column, weeks: int = WEEKS, z: float = Z) -> DataFrame:
    """One row for each of ``pairs`` and of the next seven days; a weekday or pair without history forecasts 0."""
    profile = weekday_profile(daily, as_of, weeks)
    # One row per pair with its seven weekdays: pairs meet it once and become days after that.
    of_day = [F.max(F.when(F.col("weekday") == d, F.struct("mean", "variance"))).alias(f"d{d}") for d in range(1, 8)]
    week = profile.groupBy(*PAIR).agg(*of_day).select(*PAIR, F.array(*(f"d{d}" for d in range(1, 8))).alias("week"))
    joined = with_pairs(pairs, week)
    days = F.sequence(F.date_add(as_of, 1), F.date_add(as_of, HORIZON))
    grid = joined.withColumn("forecast_date", F.explode(days)).withColumn("day", F.element_at("week", F.dayofweek("forecast_date")))
    mean, margin = F.coalesce("day.mean", F.lit(0.0)), z * F.sqrt(F.coalesce("day.variance", F.lit(0.0)))
    return grid.select(
        *PAIR,
        "forecast_date",
        F.round(mean, 6).alias("forecast"),
        F.round(F.greatest(mean - margin, F.lit(0.0)), 6).alias("lower_bound"),
        F.round(mean + margin, 6).alias("upper_bound"),
    )


def weekly_forecast(daily: DataFrame, stock: DataFrame, as_of: Column, weeks: int = WEEKS, z: float = Z, keep: Sequence[str] = ()) -> DataFrame:
    """One row per stocked pair: units over the next seven days, bounds and days until the stock is gone.

    stock: product_id, store_id, current_stock; columns of ``keep`` stay beside the forecast. An idle pair forecasts 0. Each weekday occurs once in seven
    days, so the total is the sum of the weekday means.
    """
    # Exact six-digit decimals keep the sums independent of row order.
    total = weekday_profile(daily, as_of, weeks).groupBy(*PAIR).agg(
        F.sum(F.col("mean").cast("decimal(24,6)")).cast("double").alias("_mean"),
        F.sum(F.col("variance").cast("decimal(28,6)")).cast("double").alias("_variance"),
    )
    known = stock.select(*PAIR, "current_stock", *keep).join(total, PAIR, "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_mean", "_variance")})
    margin = z * F.sqrt("_variance")
    return known.select(
        *PAIR,
        "current_stock",
        F.round("_mean", 6).alias("forecast_7d"),
        F.round(F.greatest(F.col("_mean") - margin, F.lit(0.0)), 6).alias("lower_bound"),
        F.round(F.col("_mean") + margin, 6).alias("upper_bound"),
        F.round(X.ratio(F.col("current_stock") * HORIZON, "_mean"), 6).alias("days_remaining"),
        *keep,
    )
