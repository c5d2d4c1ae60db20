"""Headline reports kept up to date by signed changes of the sales fact.

A load hands over the sales that came and those that went. Each is summed per day, store
and product with a sign, and counted per customer, product and store: a key that no row
has any more is gone from distinct counts. Only the changed sales are scanned; the sums go
to mergeable runs (``streaming.partials``), so a load costs as much as its rows. The reports
then read a few sums per key instead of the fact, through the same functions as a full scan.

A removed sale must be given as it was loaded; ``broken`` lists keys with fewer than no
rows, which tells of a removal that never was a sale. Loads count from 0; a load that is
repeated with its number replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import exprs as X
from shelfline.session import stash
from shelfline.streaming.partials import FAN, Partials

KEYS = {"by_day": "date_key", "by_store": "store_key", "by_product": "product_key"}
_SUMS = [T.StructField("_rev", T.DecimalType(38, 4)), *(T.StructField(c, T.LongType()) for c in ("_n_rev", "_n", "_units", "_rows"))]


class Maintained:
    """Sums below ``folder`` that follow the sales fact: all of them, or those ``names`` that reports read."""

    def __init__(self, folder: str, fan: int = FAN, names: Sequence[str] = (*KEYS, "members")) -> None:
        self.parts = {name: Partials(f"{folder}/{name}", [key], T.StructType([T.StructField(key, T.LongType()), *_SUMS]), fan) for name, key in KEYS.items()}
        kinds = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()), *_SUMS])
        self.parts["members"] = Partials(f"{folder}/members", ["kind", "key"], kinds, fan)
        self.parts = {name: self.parts[name] for name in names}

    def apply(self, load: int, came: DataFrame, went: DataFrame | None = None) -> None:
        """Take over one load: sales that came and, as they were loaded, sales that went."""
        columns = ["sale_id", *KEYS.values(), "customer_key", "quantity", "revenue"]
        rows = came.select(*columns, F.lit(1).alias("_sign"))
        if went is not None:
            rows = rows.unionByName(went.select(*columns, F.lit(-1).alias("_sign")))
        if len(self.parts) > 1:  # read once for each of the sums
            rows = stash(rows, "sales-changes")
        sign = F.col("_sign").cast("long")

        def counted(column: str):
            return F.when(F.col(column).isNull(), 0).otherwise(sign)

        signed = rows.select(
            *(F.col(k).cast("long").alias(k) for k in (*KEYS.values(), "customer_key")),
            (X.money("revenue") * F.col("_sign")).alias("_rev"), counted("revenue").alias("_n_rev"), counted("sale_id").alias("_n"),
            (F.col("quantity") * sign).alias("_units"), sign.alias("_rows"),
        )
        sums = [f.name for f in _SUMS]
        for name in KEYS.keys() & self.parts.keys():
            self.parts[name].add(signed.select(KEYS[name], *sums), load)
        if "members" not in self.parts:
            return
        kinds = [F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_key").alias("key")) for kind in ("customer", "product", "store")]
        self.parts["members"].add(signed.select(F.explode(F.array(*kinds)).alias("k"), *sums).select("k.kind", "k.key", *sums), load)

    def sums(self, spark: SparkSession, name: str, loads: int) -> DataFrame:
        """Sums per key of ``name`` after ``loads`` loads, for keys that still have rows."""
        return self.parts[name].state(spark, loads).where("_rows > 0").drop("_rows")

    def members(self, spark: SparkSession, loads: int) -> DataFrame:
        """(kind, key, _rev, _n) for ``kpi.summary_of``: every customer, product and store with sales, sums of customers only."""
        customer = F.col("kind") == "customer"
        return self.sums(spark, "members", loads).select("kind", "key", *(F.when(customer, F.col(c)).alias(c) for c in ("_rev", "_n")))

    def broken(self, spark: SparkSession, loads: int) -> DataFrame:
        """(state, key, rows) of keys with fewer than no rows."""
        out = None
        for name, partials in self.parts.items():
            rows = partials.state(spark, loads).where("_rows < 0").select(F.lit(name).alias("state"), F.col(partials.keys[-1]).cast("long").alias("key"), F.col("_rows").alias("n_rows"))
            out = rows if out is None else out.unionByName(rows)
        return out
