"""Row-selection building blocks: keep-first, top-k, dense keys, salted joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfline.session import stash


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order_by``; NULL keys form one group.

    ``row_number() = 1`` lets Spark drop all but one row per key before the
    shuffle (WindowGroupLimit), so a key with a third of all rows costs one row
    per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, order_by: Sequence[Column], k: int | None) -> DataFrame:
    """Sorted, and cut to ``k`` rows when the report asks for it."""
    out = df.orderBy(*order_by)
    return out if k is None else out.limit(k)


def dense_keys(df: DataFrame, order_by: Sequence[str], name: str, start: Column | int = 0) -> DataFrame:
    """``start + row_number() over (order by ...)`` without a single-task window.

    Rows are range-partitioned and sorted once. ``monotonically_increasing_id``
    then holds (partition, position in partition); the result is written so that
    both stay fixed, and a prefix sum over the per-partition counts (as many rows
    as partitions) turns them into dense keys.
    """
    ordering = [F.col(c).asc_nulls_last() for c in order_by]
    placed = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    mark = F.monotonically_increasing_id()
    placed = placed.withColumn("_mark", mark)
    placed = placed.withColumn("_part", F.shiftright("_mark", 33)).withColumn("_pos", F.col("_mark").bitwiseAND((1 << 33) - 1))
    placed = stash(placed.drop("_mark"), "dense-keys")

    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition, so this side is bounded by the partition count.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = F.lit(start) if isinstance(start, int) else start
    keyed = placed.join(F.broadcast(offsets), "_part")
    return keyed.select(
        (base + F.col("_offset") + F.col("_pos") + 1).cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join that spreads every key of ``left`` over ``salts`` tasks.

    For places where adaptive skew handling is off (streaming micro-batches);
    ``right`` is repeated once per salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def hot_keys(left: DataFrame, keys: Sequence[str], share: int) -> DataFrame:
    """(``keys``, _salts) of the keys with more than ``share`` rows: fewer than rows / ``share``."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))


def repeated(right: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right`` once per salt for hot keys, and once with salt 0 for all others."""
    marked = right.join(F.broadcast(hot), list(keys), "left")
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = 100_000) -> DataFrame:
    """Inner join of a batch that spreads only its hot keys, each over one salt per ``share`` rows; reads ``left`` twice.

    The hot keys that are broadcast are fewer than rows / ``share``.
    """
    hot = hot_keys(left, keys, share)
    salted = left.join(F.broadcast(hot), list(keys), "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")).drop("_salts")
    return salted.join(repeated(right, hot, keys), [*keys, "_salt"]).drop("_salt")
