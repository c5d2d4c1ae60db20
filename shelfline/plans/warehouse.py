"""The star schema built from the given tables, each table written once and then shared.

KPI reports, views and models read these Parquet tables, as they would in a
running warehouse, so the joins behind the fact are paid for once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators import clean, curve, dims, facts, features, forecast, increments, layout, ml, trend
from shelfline.plans import batches
from shelfline.session import ON_RELEASE, fresh_path, stash
from shelfline.sources import tables as T

_OPEN: dict[tuple[str, str], "Warehouse"] = {}


class Warehouse:
    """Tables by name, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = T.as_of()
        self._built: dict[str, DataFrame] = {}
        self._layouts: dict[str, DataFrame] = {}
        self._models: dict[bool, ml.Models] = {}
        self._maintained: dict[str, increments.Maintained] = {}

    def raw(self, name: str) -> DataFrame:
        """One of the retail inputs of ``sources.tables``, not written.

        Each joins only those columns of the order lines that it needs: a wide copy for all costs more to shuffle, write and read.
        """
        return getattr(T, name)(self.spark, self.sf_dir)

    def source(self, name: str) -> DataFrame:
        return T.table(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = stash(_BUILD[name](self), name, keep=True)
        return self._built[name]

    def planned(self, name: str) -> DataFrame:
        """The table if it is written already, else its plan: one reader alone writes nothing and takes only its columns."""
        return self._built[name] if name in self._built else _BUILD[name](self)

    def star(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in ("fact_sales", "dim_customer", "dim_product", "dim_store", "dim_date")}

    def forecast_day(self):
        """Last day with sales, as a literal for plans that need one."""
        return X.key_to_date(self["fact_sales"].agg(F.max("date_key")).scalar())

    def recent_fact(self) -> DataFrame:
        """Sales of the weeks that forecasts look back on."""
        return self["fact_sales"].where(F.col("date_key") > X.date_key(F.date_sub(self.forecast_day(), 7 * max(forecast.WEEKS, trend.WEEKS))))

    def stocked_pairs(self) -> DataFrame:
        """Pairs that ``stock_features`` describes: of the inventory, with known ids and a category."""
        return features.known_pairs(self.raw("inventory"), self["dim_product"].where(F.col("category").isNotNull()), self["dim_store"])

    def maintained(self, name: str) -> tuple[increments.Maintained, int]:
        """The sums ``name`` after three loads: all but the last month and some wrong sales, the last month, the wrong sales taken back."""
        if name not in self._maintained:
            fact = self["fact_sales"]
            first = X.date_key(F.date_sub(X.key_to_date(fact.agg(F.max("date_key")).scalar()), 30))
            unknown = {key: F.lit(-1).cast(fact.schema[key].dataType) for key in ("customer_key", "product_key", "store_key")}
            wrong = fact.where(F.col("product_key") % 7 == 3).withColumns({"sale_id": F.concat("sale_id", F.lit("-x")), **unknown})
            kept = increments.Maintained(fresh_path(self.spark, "maintained", keep=True), fan=2, names=[name])
            kept.apply(0, fact.where(F.col("date_key") < first).unionByName(wrong))
            kept.apply(1, fact.where(F.col("date_key") >= first))
            kept.apply(2, fact.limit(0), wrong)
            self._maintained[name] = kept
        return self._maintained[name], 3

    def layout(self, name: str) -> DataFrame:
        """``sales`` by month or live ``orders`` by day, and region, or sales along the ``curve`` of product and store; written and listed once."""
        if name not in self._layouts:
            path = fresh_path(self.spark, f"layout-{name}", keep=True)
            if name == "curve":
                curve.write_along_curve(self["fact_sales"], path, ["product_key", "store_key"], 16)
            elif name == "sales":  # a few rows a day: by day they would be more files than rows deserve
                layout.write_partitioned(layout.dated_sales(self["fact_sales"], self["dim_date"], self["dim_store"]), path, "month")
            else:
                orders = T.live_orders(self.source("events")).withColumn("full_date", F.to_date("timestamp"))
                layout.write_partitioned(orders.join(self["dim_store"].select("store_id", "region"), "store_id"), path)
            self._layouts[name] = layout.read_partitioned(self.spark, path)
        return self._layouts[name]

    def categories(self) -> DataFrame:
        return self["dim_product"].select("product_id", "category")

    def models(self, measured: bool = False) -> ml.Models:
        """Both models, fitted once per warehouse on all history rows; those to be ``measured`` on rows that ``ml.held_out`` keeps, on the others."""
        if measured not in self._models:
            history = self["history_features"]
            self._models[measured] = ml.fit(ml.training_rows(history.where(~ml.held_out(history)) if measured else history))
        return self._models[measured]


_BUILD: dict[str, Callable[[Warehouse], DataFrame]] = {
    "order_lines": lambda w: T.order_lines(w.spark, w.sf_dir),
    "drift_scores": lambda w: batches.scores(w["order_lines"]),
    # Lines of an order stay where the join dealt them: one shuffle of the lines for join and cleaning.
    "transactions_clean": lambda w: clean.clean_rows(
        T.transactions(w.spark, w.sf_dir, with_order=True), w.as_of, T.transaction_order(), ["order_key", *clean.KEY]
    ),
    "clean_report": lambda w: clean.report(w.raw("transactions"), w.as_of, T.transaction_order()),
    "dim_date": lambda w: dims.dim_date_covering(w.source("orders"), "o_orderdate"),
    "dim_customer": lambda w: dims.dim_customer(w.raw("customers"), w.as_of),
    "dim_product": lambda w: dims.dim_product(w.raw("products")),
    "dim_store": lambda w: dims.dim_store(w.raw("stores")),
    "fact_sales": lambda w: facts.fact_sales(
        w.planned("transactions_clean"), w["dim_customer"], w["dim_product"], w["dim_store"], w["dim_date"]
    ),
    "fact_inventory": lambda w: facts.fact_inventory(w.raw("inventory"), w["dim_product"], w["dim_store"]),
    "fact_shipments": lambda w: facts.fact_shipments(w.raw("shipments"), w.planned("fact_sales")),
    "pair_sales": lambda w: features.daily_units(w["fact_sales"], w["dim_product"], w["dim_store"], w["dim_date"]),
    "recent_sales": lambda w: features.daily_units(w.recent_fact(), w["dim_product"], w["dim_store"], w["dim_date"]),
    "pair_stock": lambda w: features.stock_counts(w["fact_inventory"], w["dim_product"], w["dim_store"], w["dim_date"]),
    "stock_features": lambda w: features.stock_features(w["recent_sales"], w["pair_stock"], w.categories(), w.forecast_day()),
    "history_features": lambda w: features.history_features(w["pair_sales"], w["pair_stock"], w.categories()),
    "stock_scores": lambda w: ml.score(w.models(), w["stock_features"]),
    "reasoning_log": lambda w: ml.forecast_log(w["stock_scores"], w["pair_sales"], w.forecast_day(), w.as_of),
}


def open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of this application over ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Warehouse(spark, sf_dir)
    return _OPEN[key]


def _forget(spark: SparkSession) -> None:
    for key in [k for k in _OPEN if k[0] == spark.sparkContext.applicationId]:
        del _OPEN[key]


ON_RELEASE.append(_forget)
