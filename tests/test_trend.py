from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import trend

LAST = date(2024, 3, 31)


def history(draw, pairs, weeks, noise):
    """Units per pair and day with weekday levels, a trend and noise; the week after ``LAST`` too."""
    data, ahead = [], {}
    for p in range(pairs):
        levels, slope = draw.integers(30, 90, 7), draw.uniform(-1.5, 2.5)
        for back in range(-7, weeks * 7):
            day = LAST - timedelta(days=back)
            units = int(max(0, round(levels[day.weekday()] + slope * (weeks - 1 - back // 7) + draw.normal(0, noise))))
            if back < 0:
                ahead[f"p{p}", day] = units
            elif units:
                data.append((f"p{p}", "s", day, units))
    return data, ahead


def forecasts(spark, data, weeks=8, pairs=None):
    df = spark.createDataFrame(data, "product_id string, store_id string, date date, units long")
    pairs = df.select("product_id", "store_id").distinct() if pairs is None else pairs
    return {(r.product_id, r.forecast_date): r for r in trend.forecast(df, pairs, F.lit(LAST), weeks).collect()}


def test_bounds_cover_a_held_out_week(spark):
    data, ahead = history(np.random.default_rng(4), 150, 8, 6.0)
    got = forecasts(spark, data)
    inside = [got[k].lower_bound <= units <= got[k].upper_bound for k, units in ahead.items()]
    assert len(inside) == 150 * 7 and 0.93 <= np.mean(inside) <= 0.975
    flat = [abs(np.mean([u for p, _, d, u in data if p == k[0] and d.weekday() == k[1].weekday()]) - units) for k, units in ahead.items()]
    assert np.mean([abs(got[k].forecast - units) for k, units in ahead.items()]) < np.mean(flat)


@pytest.mark.parametrize("weeks", [2, 5, 8])
def test_equals_least_squares(spark, weeks):
    data, _ = history(np.random.default_rng(weeks), 3, weeks, 9.0)
    data = [r for k, r in enumerate(data) if k % 4] + [("p0", "s", LAST - timedelta(days=weeks * 7), 10**6)]  # gaps count as 0; older days do not count
    got = forecasts(spark, data, weeks)
    for p in range(3):
        units = np.zeros(weeks * 7)
        for product, _, day, n in data:
            back = (LAST - day).days
            if product == f"p{p}" and back < weeks * 7:
                units[back] += n
        week = weeks - 1 - np.arange(weeks * 7) // 7
        days = [(LAST - timedelta(days=int(b))).weekday() for b in range(weeks * 7)]
        x = np.column_stack([np.eye(7)[days], week])
        found, *_ = np.linalg.lstsq(x, units, rcond=None)
        rest = ((units - x @ found) ** 2).sum() / (7 * weeks - 8)
        for step in range(1, 8):
            day = LAST + timedelta(days=step)
            row = np.append(np.eye(7)[day.weekday()], weeks)
            scale = 1 + row @ np.linalg.inv(x.T @ x) @ row
            mean, margin = row @ found, trend.QUANTILE * np.sqrt(rest * scale)
            r = got[f"p{p}", day]
            assert (r.slope, r.forecast) == (pytest.approx(found[7], abs=1e-5), pytest.approx(max(mean, 0), abs=1e-5))
            assert (r.lower_bound, r.upper_bound) == (pytest.approx(max(mean - margin, 0), abs=1e-4), pytest.approx(max(mean + margin, 0), abs=1e-4))


def test_idle_pairs_and_empty_tables(spark):
    pairs = spark.createDataFrame([("x", "y"), ("x", "y")], "product_id string, store_id string")
    got = forecasts(spark, [("p", "s", LAST - timedelta(days=400), 5)], 8, pairs)
    assert len(got) == 7 and {(r.forecast, r.lower_bound, r.upper_bound) for r in got.values()} == {(0.0, 0.0, 0.0)}
    assert forecasts(spark, [], 8, pairs.limit(0)) == {}
    with pytest.raises(ValueError):
        trend.fit(pairs, F.lit(LAST), 1)
