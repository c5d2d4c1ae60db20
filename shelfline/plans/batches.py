"""Incoming batches for drift governance: order lines with columns the registry does not know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators import drift
from shelfline.schemas import DRIFT_REGISTRY

REGISTERED = DRIFT_REGISTRY["transactions"]

# Further columns of each batch.
BATCHES = {
    "clear": ["l_tax", "l_shipdate"],
    "mixed": ["l_tax", "l_shipdate", "l_returnflag", "o_totalprice"],
    "many": ["l_tax", "l_shipdate", "o_totalprice", "l_discount"],
    "noisy": ["l_returnflag", "l_linestatus", "o_orderstatus", "flag_a", "flag_b", "flag_c"],
}


def incoming(order_lines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    made = {
        "flag_a": F.col("l_returnflag"),
        "flag_b": F.col("l_linestatus"),
        "flag_c": F.when(F.col("l_returnflag") != "A", F.col("o_orderstatus")),
    }
    return order_lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("o_orderpriority").alias("payment_method"),
        *[made.get(c, F.col(c)).alias(c) for c in extra],
    )


def of_batches(once: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``columns``, once for every batch that has the column."""
    batches = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for c in columns for x in (c, [b for b, extra in BATCHES.items() if c in extra])))
    rest = [c for c in once.columns if c != "table_name"]
    return once.select(F.explode(F.element_at(batches, F.col("column_name"))).alias("table_name"), *rest)


def scores(order_lines: DataFrame) -> DataFrame:
    """Scores of the new columns of every batch; a column of several batches is counted once."""
    columns = sorted({c for extra in BATCHES.values() for c in extra})
    return of_batches(drift.score_new_columns(incoming(order_lines, columns), REGISTERED), columns)
