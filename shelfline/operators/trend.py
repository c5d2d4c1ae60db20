"""Demand forecast by regression on weekday and trend, solved by column expressions.

Units of a pair on a day are a level per weekday plus one slope per week. Over whole weeks
every weekday occurs equally often (days without sales count as 0), so the normal equations fall apart:
the levels are weekday means, the slope is the sum of (week - middle week) * units over its
fixed sum of squares. All they need are sums that add up over rows in any order: units, units by week number,
and squares; they are whole numbers, so results do not depend on the order of rows.

The bounds are those of a single new day: residual variance (7 * weeks - 8 degrees of freedom) times
1 + 1 / weeks + the distance from the middle week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators.features import PAIR
from shelfline.operators.forecast import with_pairs

WEEKS = 8
HORIZON = 7
QUANTILE = 2.02  # of Student's t at 97.5 % for 48 degrees of freedom


def sums(daily: DataFrame, as_of: Column, weeks: int = WEEKS) -> DataFrame:
    """Per pair and weekday over the last ``weeks`` weeks: units, units times week number (0 is the oldest), squares."""
    recent = daily.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(as_of, weeks * 7)))
    week = F.lit(weeks - 1) - F.floor(F.datediff(as_of, "date") / 7)
    units = F.col("units").cast("long")
    return recent.groupBy(*PAIR, F.dayofweek("date").alias("weekday")).agg(
        F.sum(units).alias("s"), F.sum(units * week).cast("long").alias("sw"), F.sum(units * units).alias("ss")
    )


def fit(daily: DataFrame, as_of: Column, weeks: int = WEEKS) -> DataFrame:
    """One row per pair: ``slope`` per week, residual ``variance``, and per weekday the sum of units.

    With W weeks the slope is (sum of w * y - (W - 1) / 2 * sum of y) / D, D = 7 * W * (W * W - 1) / 12,
    and the residual sum is squares - sum over weekdays of s * s / W - slope * slope * D.
    """
    if weeks < 2:
        raise ValueError("a trend needs two weeks or more")
    per = sums(daily, as_of, weeks)
    of_day = [F.coalesce(F.sum(F.when(F.col("weekday") == d, F.col("s"))), F.lit(0)).alias(f"d{d}") for d in range(1, 8)]
    whole = per.groupBy(*PAIR).agg(F.sum("s").alias("s"), F.sum("sw").alias("sw"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s")).alias("sq"), *of_day)
    spread = 7 * weeks * (weeks * weeks - 1)  # 12 D
    cross = F.lit(2) * F.col("sw") - F.lit(weeks - 1) * F.col("s")  # 2 D * slope
    slope = X.ratio(cross * 6, F.lit(spread))
    rest = X.ratio(F.lit(weeks) * F.col("ss") - F.col("sq"), F.lit(weeks)) - X.ratio(cross * cross * 3, F.lit(spread))
    variance = F.greatest(rest, F.lit(0.0)) / F.lit(float(7 * weeks - 8))
    return whole.select(*PAIR, slope.alias("slope"), variance.alias("variance"), *(f"d{d}" for d in range(1, 8)))


def forecast(daily: DataFrame, pairs: DataFrame, as_of: Column, weeks: int = WEEKS, quantile: float = QUANTILE) -> DataFrame:
    """One row for each of ``pairs`` and of the next seven days; a pair without recent sales forecasts 0. Never below 0."""
    fitted = with_pairs(pairs, fit(daily, as_of, weeks))
    days = F.explode(F.sequence(F.date_add(as_of, 1), F.date_add(as_of, HORIZON)))
    grid = fitted.withColumn("forecast_date", days)
    total = F.element_at(F.array(*(F.col(f"d{d}") for d in range(1, 8))), F.dayofweek("forecast_date"))
    ahead = (weeks + 1) / 2  # weeks from the middle week to the week to come
    mean = F.coalesce(X.ratio(total, F.lit(weeks)) + F.col("slope") * F.lit(ahead), F.lit(0.0))
    scale = 1 + 1 / weeks + ahead * ahead * 12 / (7 * weeks * (weeks * weeks - 1))
    margin = F.lit(quantile) * F.sqrt(F.coalesce(F.col("variance"), F.lit(0.0)) * F.lit(scale))

    def shown(value: Column) -> Column:
        return F.round(F.greatest(value, F.lit(0.0)), 6)

    return grid.select(
        *PAIR, "forecast_date", shown(mean).alias("forecast"), shown(mean - margin).alias("lower_bound"), shown(mean + margin).alias("upper_bound"), F.round(F.coalesce("slope", F.lit(0.0)), 6).alias("slope")
    )
