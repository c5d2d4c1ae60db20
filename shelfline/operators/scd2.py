"""Type-2 history for customers: expire changed rows, add new versions, no in-place update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators.dims import CUSTOMER_COLUMNS, next_key
from shelfline.operators.rows import dense_keys, keep_first


def duplicate_versions(dim: DataFrame) -> DataFrame:
    """(customer_id, version) that occur more than once."""
    return dim.groupBy("customer_id", "version").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def several_current(dim: DataFrame) -> DataFrame:
    """Customers with more than one current row."""
    return (
        dim.where("is_current").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    )


def checks(dim: DataFrame) -> DataFrame:
    """(check_name, violations): all zero for a sound dimension."""
    without_current = dim.groupBy("customer_id").agg(F.max(F.col("is_current").cast("int")).alias("c")).where("c = 0")
    found = [
        ("duplicate_versions", duplicate_versions(dim)),
        ("several_current", several_current(dim)),
        ("no_current", without_current),
    ]
    out = None
    for name, rows in found:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def latest_per_customer(snapshot: DataFrame, newest_first: Sequence[Column] | None = None) -> DataFrame:
    """One row per customer, so that a customer in several files cannot match twice."""
    order = newest_first or [F.asc_nulls_last(c) for c in ("city", "name", "email", "phone")]
    return keep_first(snapshot, ["customer_id"], order)


def changed_customers(dim: DataFrame, snapshot: DataFrame, track: Sequence[str] = ("city",)) -> DataFrame:
    """Current rows whose tracked columns differ in the snapshot (NULL equals '').

    Columns: the snapshot's values plus ``current_version``.
    """
    current = dim.where("is_current").select(
        "customer_id", F.col("version").alias("current_version"), *[F.col(c).alias(f"_old_{c}") for c in track]
    )
    differs = F.lit(False)
    for c in track:
        differs = differs | (X.blank_null(c) != X.blank_null(f"_old_{c}"))
    joined = snapshot.select("customer_id", "name", "email", "phone", "city").join(current, "customer_id").where(differs)
    return joined.drop(*[f"_old_{c}" for c in track])


def apply(
    dim: DataFrame,
    snapshot: DataFrame,
    as_of: Column,
    track: Sequence[str] = ("city",),
    newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """The dimension after taking over a snapshot.

    Rows of changed customers are expired, a new version is added unless it
    exists, and other rows pass through. Applying the same snapshot again changes
    nothing. Write the result to a new path and swap: inputs stay untouched.
    """
    if not duplicate_versions(dim).isEmpty():
        raise ValueError("the dimension holds duplicate (customer_id, version) rows; repair it first")
    changed = changed_customers(dim, latest_per_customer(snapshot, newest_first), track)

    marks = changed.select("customer_id", F.lit(True).alias("_changed")).distinct()
    expire = F.col("_changed").isNotNull() & F.col("is_current")
    carried = (
        dim.join(marks, "customer_id", "left")
        .withColumn("valid_to", F.when(expire, as_of).otherwise(F.col("valid_to")))
        .withColumn("is_current", F.col("is_current") & ~expire)
        .select(*CUSTOMER_COLUMNS)
    )

    added = (
        changed.withColumn("version", (F.col("current_version") + 1).cast("int"))
        .join(dim.select("customer_id", "version"), ["customer_id", "version"], "left_anti")
        .select(
            "customer_id",
            "name",
            "email",
            "phone",
            "city",
            as_of.alias("valid_from"),
            F.lit(None).cast("timestamp_ntz").alias("valid_to"),
            F.lit(True).alias("is_current"),
            "version",
        )
    )
    keyed = dense_keys(added, ["customer_id", "version"], "customer_key", next_key(dim, "customer_key"))
    return carried.unionByName(keyed.select(*CUSTOMER_COLUMNS))
