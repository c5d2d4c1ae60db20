"""Rows ordered along a space-filling curve, so that filters on any of its columns skip most row groups.

Values are scaled to ``BITS`` bits between their least and greatest, and the bits of all columns are
interleaved (Morton order). Files hold consecutive stretches of the curve, that is small boxes in all
columns at once: Parquet's least and greatest values per row group prune by each column, and Bloom filters
by equality where a box is wide. Date folders alone prune by date only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
ROW_GROUP = 8 << 20


def scaled(column: str, least: float, greatest: float) -> Column:
    """The place of a value between the bounds as a whole number of ``BITS`` bits; nulls and smaller values are 0."""
    top = (1 << BITS) - 1
    width = max(float(greatest) - float(least), 1.0)
    place = F.floor((F.col(column).cast("double") - F.lit(float(least))) * (top / width))
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def interleaved(places: Sequence[Column]) -> Column:
    """The bits of several whole numbers, highest bits first, in turn."""
    n = len(places)
    if n * BITS > 63:
        raise ValueError("at most three columns")
    out = F.lit(0).cast("long")
    for i, place in enumerate(places):
        for bit in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long")), bit * n + n - 1 - i))
    return out


def along_curve(rows: DataFrame, columns: Sequence[str], parts: int) -> DataFrame:
    """``rows`` dealt to ``parts`` tasks by stretches of the curve, in its order. Reads the bounds when called: two numbers a column."""
    bounds = rows.agg(*(f(c).cast("double").alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    places = [scaled(c, bounds[f"lo_{i}"] or 0.0, bounds[f"hi_{i}"] or 0.0) for i, c in enumerate(columns)]
    placed = rows.withColumn("_curve", interleaved(places))
    # Rows of one place may be any share: the row's hash deals them over several ranges.
    return placed.repartitionByRange(parts, "_curve", F.xxhash64(*rows.columns)).sortWithinPartitions("_curve").drop("_curve")


def write_along_curve(rows: DataFrame, path: str, columns: Sequence[str], parts: int, row_group: int = ROW_GROUP) -> None:
    """Parquet files along the curve with Bloom filters on ``columns``."""
    writer = along_curve(rows, columns, parts).write.mode("overwrite").option("parquet.block.size", row_group)
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
