"""Registered queries: name -> function of (spark, sf_dir).

Every entry runs over the whole given tables. Operator entries (cleaning,
dimensions, facts, ...) run the operator itself; reports read the star schema
that ``plans.warehouse`` derives from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from shelfline import schemas as S
from shelfline.functions import exprs as X
from shelfline.operators import (
    access, basket, clean, dims, drift, facts, features, forecast, history, ingest, layout, ml, registry, runlog, scd2, trend,
)
from shelfline.plans import batches, kpi
from shelfline.plans.warehouse import Warehouse, open_warehouse
from shelfline.session import fresh_path, stash
from shelfline.sources import readers, tables as T, writers
from shelfline.streaming import orders as live

_QUERIES: dict[str, Callable[[Warehouse], DataFrame]] = {}

STAMP = datetime(2024, 1, 31, 6, 0, 0)
LATER = "2002-02-01 00:00:00"


def _query(fn: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: X.edge(fn(open_warehouse(spark, sf_dir)))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# --- KPI reports -------------------------------------------------------------------
@_query
def kpi_daily_revenue(w):
    return kpi.daily_revenue(w["fact_sales"], w["dim_date"])


@_query
def kpi_daily_revenue_last30(w):
    return kpi.recent_daily_revenue(w["fact_sales"], w["dim_date"])


@_query
def kpi_monthly_revenue(w):
    return kpi.monthly_revenue(w["fact_sales"], w["dim_date"])


@_query
def kpi_city_sales(w):
    return kpi.city_sales(w["fact_sales"], w["dim_store"])


@_query
def kpi_top_products(w):
    return kpi.top_products(w["fact_sales"], w["dim_product"])


@_query
def top5_products(w):
    return kpi.top5_products(w["fact_sales"], w["dim_product"])


@_query
def kpi_turnover(w):
    return kpi.turnover(w["fact_sales"], w["dim_product"])


@_query
def kpi_stockout_top20(w):
    return kpi.turnover(w["fact_sales"], w["dim_product"], 20)


@_query
def kpi_delivery_monthly(w):
    return kpi.delivery_by_month(w.planned("fact_shipments"), w["dim_date"])


@_query
def kpi_seasonal(w):
    return kpi.seasonal_demand(w["fact_sales"], w["dim_date"])


@_query
def kpi_new_vs_returning(w):
    return kpi.new_vs_returning(w["fact_sales"], w["dim_date"])


@_query
def kpi_customer_value_city(w):
    return kpi.customer_value_by_city(w["fact_sales"], w["dim_customer"])


# The usual ladders end far below this data's order values; wider ones split it.
VALUE_STEPS = [(20_000_000, "Low Value"), (40_000_000, "Medium Value"), (60_000_000, "High Value")]
FREQUENCY_STEPS = [(1, "One-time"), (20, "Occasional"), (30, "Regular")]


@_query
def kpi_customer_value(w):
    return kpi.customer_value(w["fact_sales"], w["dim_customer"], FREQUENCY_STEPS, VALUE_STEPS)


@_query
def kpi_customer_value_default(w):
    """With the usual ladders."""
    return kpi.customer_value(w["fact_sales"], w["dim_customer"])


@_query
def kpi_summary(w):
    return kpi.summary(w["fact_sales"])


# The same reports from sums that three loads kept up to date, one of them taking sales back.
def _sums_by(w, name):
    kept, loads = w.maintained(name)
    return kept.sums(w.spark, name, loads)


@_query
def maintained_daily_revenue(w):
    return kpi.daily_revenue(_sums_by(w, "by_day"), w["dim_date"])


@_query
def maintained_monthly_revenue(w):
    return kpi.monthly_revenue(_sums_by(w, "by_day"), w["dim_date"])


@_query
def maintained_seasonal(w):
    return kpi.seasonal_demand(_sums_by(w, "by_day"), w["dim_date"])


@_query
def maintained_city_sales(w):
    return kpi.city_sales(_sums_by(w, "by_store"), w["dim_store"])


@_query
def maintained_top_products(w):
    return kpi.top_products(_sums_by(w, "by_product"), w["dim_product"])


@_query
def maintained_summary(w):
    kept, loads = w.maintained("members")
    return kpi.summary_of(kept.members(w.spark, loads))


@_query
def dashboard_cards(w):
    return kpi.dashboard_cards(w["fact_sales"], w["dim_date"], w["dim_store"], w["dim_customer"])


@_query
def chart_revenue(w):
    return kpi.revenue_chart(w["fact_sales"], w["dim_date"])


@_query
def chart_city(w):
    return kpi.city_chart(w["fact_sales"], w["dim_store"])


@_query
def chart_customers(w):
    return kpi.customer_chart(w["fact_sales"], w["dim_customer"])


def _order_items(w):
    # order id of the sale = the part of the sale id before the line number
    return w.planned("transactions_clean").select(F.split_part("transaction_id", F.lit("-"), F.lit(1)).alias("order_id"), "product_id")


@_query
def product_pairs(w):
    return basket.product_pairs(_order_items(w), "order_id", "product_id")


@_query
def frequent_product_pairs(w):
    """Pairs in at least two orders."""
    return basket.product_pairs(_order_items(w), "order_id", "product_id", 2)


@_query
def top_combos_recent(w):
    return kpi.top_combos(w["fact_sales"], w["dim_product"], w["dim_store"])


@_query
def top_combos_recent_true_days(w):
    return kpi.top_combos(w["fact_sales"], w["dim_product"], w["dim_store"], true_days=True)


# --- dimensions and history -----------------------------------------------------------
@_query
def dim_date(w):
    return dims.dim_date_covering(w.source("orders"), "o_orderdate")


@_query
def dim_customer(w):
    return dims.dim_customer(w.raw("customers"), w.as_of)


@_query
def dim_product(w):
    return dims.dim_product(w.raw("products"))


@_query
def dim_store(w):
    return dims.dim_store(w.raw("stores"))


@_query
def store_counts_by_region(w):
    return dims.store_counts_by_region(w["dim_store"])


@_query
def store_regions(w):
    return dims.regions(w["dim_store"])


@_query
def new_customers(w):
    # The dimension as it was before customers with a negative balance signed up.
    known = dims.dim_customer(w.raw("customers").where("balance >= 0"), w.as_of)
    return dims.insert_new(known, w.raw("customers"), T.as_of(LATER))


@_query
def scd2_apply(w):
    return scd2.apply(w["dim_customer"], w.raw("customer_snapshot"), T.as_of(LATER))


@_query
def scd2_changed_customers(w):
    return scd2.changed_customers(w["dim_customer"], scd2.latest_per_customer(w.raw("customer_snapshot")))


@_query
def scd2_checks(w):
    return scd2.checks(scd2.apply(w["dim_customer"], w.raw("customer_snapshot"), T.as_of(LATER)))


MUCH_LATER = "2002-03-01 00:00:00"


def _later_customers(w):
    """A third extract: a fifth of the customers is missing, and some have moved to Surat."""
    rows = w.raw("customers").where(F.substring("customer_id", -1, 1) != "0")
    return rows.withColumn("city", F.when(F.substring("customer_id", -1, 1).isin("3", "7"), F.lit("Surat")).otherwise(F.col("city")))


@_query
def scd2_any_order(w):
    """History of three snapshots that arrive newest first; the first one lacks customers with a negative balance."""
    kept = history.History(w.spark, fresh_path(w.spark, "history"))
    kept.apply(_later_customers(w), datetime.fromisoformat(MUCH_LATER))
    kept.apply(w.raw("customers").where("balance >= 0"), datetime.fromisoformat(T.AS_OF))
    kept.apply(w.raw("customer_snapshot"), datetime.fromisoformat(LATER))
    return kept.table().drop("customer_key")


@_query
def key_registry(w):
    """Keys over two loads: those of the first survive, late customers get new ones."""
    customers = w.raw("customers").select("customer_id", "balance")
    ids = types.StructType([customers.schema["customer_id"]])
    keys = registry.KeyRegistry(w.spark, fresh_path(w.spark, "keys"), ids, "customer_key")
    first = stash(keys.assign(customers.where("balance >= 0")).select("customer_id", F.col("customer_key").alias("first_key")), "first-keys")
    both = keys.assign(customers).join(first, "customer_id", "left")
    top = first.agg(F.max("first_key")).scalar()
    return both.agg(
        F.count(F.lit(1)).alias("n_customers"), F.countDistinct("customer_key").alias("n_keys"),
        F.count(F.when(F.col("first_key") != F.col("customer_key"), 1)).alias("n_changed"), F.count(F.when(F.col("customer_key") > top, 1)).alias("n_late"),
    )


# --- facts and layout -------------------------------------------------------------------
@_query
def fact_sales(w):
    return facts.fact_sales(
        w["transactions_clean"], w["dim_customer"], w["dim_product"], w["dim_store"], w["dim_date"]
    )


@_query
def fact_inventory(w):
    return facts.fact_inventory(w.raw("inventory"), w["dim_product"], w["dim_store"])


@_query
def inventory_load_counts(w):
    return facts.inventory_load_counts(w.raw("inventory"), w["dim_product"], w["dim_store"])


@_query
def inventory_pairs(w):
    return features.stocked_pairs(w["fact_inventory"], w["dim_product"], w["dim_store"])


@_query
def fact_shipments(w):
    return facts.fact_shipments(w.raw("shipments"), w["fact_sales"])


DAY, WEEK_START = "1998-03-25", "1998-03-19"


def _sums(rows):
    return rows.agg(X.sum_money("revenue").alias("total_revenue"), F.count("sale_id").alias("transaction_count"))


@_query
def partition_prune_sum(w):
    """Revenue of one day, from the folders of its month."""
    return _sums(layout.on_days(w.layout("sales"), DAY, DAY, "month")).select(F.lit(DAY).cast("date").alias("day"), "*")


@_query
def partition_week_sum(w):
    """Revenue of seven days."""
    return _sums(layout.on_days(w.layout("sales"), WEEK_START, DAY, "month"))


@_query
def partition_region_sum(w):
    """Revenue of one region by month, from the region's folders."""
    rows = layout.in_region(w.layout("sales"), "West")
    return _sums(rows.groupBy(F.trunc("full_date", "month").alias("month")))


@_query
def curve_product_store_sum(w):
    """Sales of some products in some stores by product, from the row groups of their box on the curve."""
    rows = w.layout("curve").where(F.col("product_key").between(20, 60) & F.col("store_key").between(2, 4))
    return _sums(rows.groupBy("product_key"))


@_query
def partition_full_sum(w):
    """Everything, read through the layout."""
    return _sums(w.layout("sales"))


@_query
def partition_missing_day_sum(w):
    """A day without sales: no folder, and sums of nothing."""
    return _sums(layout.on_days(w.layout("sales"), "2030-01-01", "2030-01-01", "month"))


def _live_sums(rows):
    amount = X.money("price") * F.col("quantity")
    return rows.groupBy("region").agg(X.dbl(F.sum(amount)).alias("revenue"), F.count("order_id").alias("orders"))


@_query
def partition_live_day_sum(w):
    """Live orders of one day by region, from the day's folders of the daily layout."""
    return _live_sums(layout.on_days(w.layout("orders"), "2024-01-20", "2024-01-20"))


@_query
def partition_live_week_sum(w):
    return _live_sums(layout.on_days(w.layout("orders"), "2024-01-14", "2024-01-20"))


@_query
def full_scan_day_sum(w):
    """The same sum from the unpartitioned fact."""
    return _sums(w["fact_sales"].where("date_key = 19980325"))


# --- access ------------------------------------------------------------------------------
@_query
def view_analyst(w):
    return access.view("analyst", w.star())


@_query
def view_store_manager(w):
    return access.view("store_manager", w.star(), store_key=1)


@_query
def view_finance(w):
    return access.view("finance", w.star())


@_query
def view_admin(w):
    return access.view("admin", w.star())


@_query
def view_counts(w):
    views = access.create_views(w.star())
    return writers.row_counts({name: w.spark.table(name) for name in views})


@_query
def contract_check(w):
    star = w.star()
    return access.contract_check(w.spark, star).join(writers.row_counts(star), "table_name")


@_query
def table_counts(w):
    return writers.row_counts({**w.star(), "fact_inventory": w["fact_inventory"], "fact_shipments": w["fact_shipments"]})


# --- sources and sinks ----------------------------------------------------------------------
def _inventory_text(w):
    columns = ["store_id", "product_id", "date", "stock_level"]
    return w.raw("inventory").select(*columns)


@_query
def source_csv_relabel(w):
    """CSV with the header in another order than the data, read by position."""
    path = fresh_path(w.spark, "inventory-csv")
    wrong = _inventory_text(w).toDF("date", "store_id", "product_id", "stock_level")
    wrong.write.option("header", True).csv(path)
    return readers.read_inventory_csv(w.spark, path)


@_query
def source_csv_inferred(w):
    path = fresh_path(w.spark, "stores-csv")
    w.raw("stores").write.option("header", True).csv(path)
    return readers.read_csv(w.spark, path)


@_query
def source_snapshot_latest(w):
    """Two customer snapshots in one folder; only the newer one counts."""
    folder = fresh_path(w.spark, "snapshots")
    old, new = w.raw("customers"), w.raw("customer_snapshot")
    writers.write_snapshot(old, folder, "customers", STAMP)
    writers.write_snapshot(new, folder, "customers", STAMP + timedelta(days=1))
    return readers.read_latest_snapshot(w.spark, f"{folder}/customers_*").drop("balance")


@_query
def source_snapshot_all(w):
    """Rows per snapshot over all files that match the glob."""
    folder = fresh_path(w.spark, "snapshots")
    writers.write_snapshot(w.raw("customers"), folder, "customers", STAMP)
    writers.write_snapshot(w.raw("customer_snapshot"), folder, "customers", STAMP + timedelta(days=1))
    rows = readers.read_snapshots(w.spark, f"{folder}/customers_*")
    return rows.groupBy("snapshot_file").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("city").alias("n_cities"))


@_query
def source_fallback(w):
    """No CSV there, so the Parquet copy is read."""
    folder = fresh_path(w.spark, "fallback")
    w.raw("transactions").write.parquet(f"{folder}/transactions.parquet")
    return readers.read_csv_or_parquet(w.spark, f"{folder}/transactions.csv", f"{folder}/transactions.parquet")


@_query
def source_fallback_csv(w):
    """Both copies are there, the Parquet one empty: the CSV is read."""
    folder = fresh_path(w.spark, "fallback")
    rows = w.raw("transactions")
    rows.write.option("header", True).csv(f"{folder}/transactions.csv")
    rows.limit(0).write.parquet(f"{folder}/transactions.parquet")
    return readers.read_csv_or_parquet(w.spark, f"{folder}/transactions.csv", f"{folder}/transactions.parquet", rows.schema)


@_query
def records_json(w):
    return X.as_json(w["dim_store"].select("store_key", "store_id", "store_name", "city", "region"))


@_query
def sink_rebuild_append(w):
    """Rebuild a table twice, then append once: rows must be there exactly twice."""
    path = fresh_path(w.spark, "sink")
    sales = w["fact_sales"].select("sale_id", "date_key", "quantity")
    writers.rebuild(sales, path)
    writers.rebuild(sales, path)
    writers.append(sales, path)
    rows = readers.read_parquet(w.spark, path)
    return rows.groupBy("date_key").agg(F.count("sale_id").alias("n_rows"), F.sum("quantity").alias("units"))


# --- ingest --------------------------------------------------------------------------------
STRICT_TRANSACTIONS = S.TableSchema(
    "transactions",
    required=["transaction_id", "date", "store_id", "customer_id", "product_id", "quantity", "price"],
    optional=["discount"],
)


@_query
def ingest_valid(w):
    return ingest.validate_split(w.raw("transactions"), STRICT_TRANSACTIONS)[0]


@_query
def ingest_quarantine(w):
    return ingest.validate_split(w.raw("transactions"), STRICT_TRANSACTIONS)[1]


@_query
def ingest_missing_column(w):
    """A required column is absent: every row is quarantined, with all its reasons."""
    rows = w.raw("transactions").drop("store_id")
    rejected = ingest.validate_split(rows, STRICT_TRANSACTIONS)[1]
    return rejected.groupBy(ingest.REASON).agg(F.count(F.lit(1)).alias("n_rows"))


@_query
def ingest_run_counts(w):
    """CSV in, Parquet and quarantine CSV out, counts back."""
    path = fresh_path(w.spark, "transactions-csv")
    raw = w.raw("transactions").select(*S.raw_schema("transactions").names)
    raw.write.option("header", True).option("nullValue", "NA").csv(path)
    counts, _ = ingest.scratch_run(
        w.spark,
        "transactions",
        path,
        STAMP,
        registry={"transactions": STRICT_TRANSACTIONS},
        file_schema=S.raw_schema("transactions"),
    )
    return counts


@_query
def ingest_read_back(w):
    """What the ingest sinks hold: the valid rows and the quarantined ones, read from their files."""
    path = fresh_path(w.spark, "transactions-csv")
    raw = w.raw("transactions").select(*S.raw_schema("transactions").names)
    raw.write.option("header", True).option("nullValue", "NA").csv(path)
    _, folder = ingest.scratch_run(
        w.spark, "transactions", path, STAMP, registry={"transactions": STRICT_TRANSACTIONS}, file_schema=S.raw_schema("transactions")
    )
    valid = readers.read_latest_snapshot(w.spark, f"{folder}/transactions_2*.parquet")
    marked = types.StructType([*S.raw_schema("transactions").fields, types.StructField(ingest.REASON, types.StringType())])
    rejected = readers.read_csv(w.spark, f"{folder}/*quarantine*", marked)

    def content(rows, sink, reason):
        return rows.groupBy(reason.alias(ingest.REASON)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("units")).withColumn("sink", F.lit(sink))

    return content(valid, "valid", F.lit(None).cast("string")).unionByName(content(rejected, "quarantine", F.col(ingest.REASON)))


# --- drift --------------------------------------------------------------------------------
def _governed(w):
    """Scores, decisions, approval queue and change log over the batches."""
    scores = w["drift_scores"]
    decisions = drift.decide(scores)
    requests = drift.queue(scores, decisions, w.as_of)
    return scores, decisions, requests, drift.change_log(scores, decisions, requests, w.as_of)


@_query
def drift_confidence(w):
    return w["drift_scores"].withColumn("sample_values", F.concat_ws("|", "sample_values"))


@_query
def drift_confidence_sketched(w):
    """Confidence of every new column of the batches, from sketches in one scan."""
    columns = sorted({c for extra in batches.BATCHES.values() for c in extra})
    scores = drift.sketched_scores(batches.incoming(w["order_lines"], columns), batches.REGISTERED)
    return batches.of_batches(scores, columns).drop("counted")


@_query
def drift_decision(w):
    return drift.decide(w["drift_scores"])


@_query
def drift_verdict(w):
    lines = w["order_lines"]
    known = drift.verdict(batches.incoming(lines), batches.REGISTERED, "known")
    broken = drift.verdict(batches.incoming(lines).drop("price", "store_id"), batches.REGISTERED, "broken")
    out = known.unionByName(broken)
    for name, extra in batches.BATCHES.items():
        scores = w["drift_scores"].where(F.col("table_name") == name)
        out = out.unionByName(drift.verdict(batches.incoming(lines, extra), batches.REGISTERED, name, scores))
    return out


@_query
def drift_log(w):
    return _governed(w)[3]


@_query
def approval_queue(w):
    return drift.pending(_governed(w)[2]).drop("decision_json")


@_query
def approval_requests(w):
    """The changes that each request holds, as JSON text."""
    return drift.pending(_governed(w)[2]).select("queue_id", "table_name", "decision_json")


@_query
def approval_changes(w):
    return drift.expand_changes(_governed(w)[2])


@_query
def approval_apply(w):
    """The queue after the 'many' request was approved."""
    _, _, requests, log = _governed(w)
    picked = requests.where("table_name = 'many'")
    return drift.resolve(requests, log, picked, "approved", "admin", T.as_of(LATER))[0].drop("decision_json")


@_query
def approval_log(w):
    """The change log after the 'noisy' request was rejected."""
    _, _, requests, log = _governed(w)
    picked = requests.where("table_name = 'noisy'")
    return drift.resolve(requests, log, picked, "rejected", "admin", T.as_of(LATER))[1]


@_query
def drift_history(w):
    return drift.history(_governed(w)[3])


@_query
def drift_status_counts(w):
    return drift.status_counts(_governed(w)[3])


# --- cleaning --------------------------------------------------------------------------------
@_query
def clean_transactions(w):
    return clean.clean(w.raw("transactions"), w.as_of, T.transaction_order())


@_query
def clean_report(w):
    return clean.report(w.raw("transactions"), w.as_of, T.transaction_order())


@_query
def clean_text_dates(w):
    """Cleaning of rows whose dates are text; what is no date is dropped like a late one."""
    order = F.split_part("transaction_id", F.lit("-"), F.lit(1)).cast("long")
    text = F.when(order % 400 == 1, F.lit("some day")).otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    rows = clean.clean_rows(w.raw("transactions").withColumn("date", text), w.as_of, T.transaction_order())
    return rows.select("transaction_id", "date")


@_query
def anomaly_flags(w):
    """Anomalies over the prices times quantities of cleaned rows, which have a long tail."""
    amounts = w["transactions_clean"].withColumn("price", X.money(F.col("price") * F.col("quantity")))
    return clean.flag_anomalies(amounts, 2).where("is_anomaly").select("transaction_id", "price", "is_anomaly")


# --- run log ---------------------------------------------------------------------------------
def _run_log(w):
    runs = T.batch_runs(w.source("events"))
    results = runs.withColumn(
        "error_message",
        F.when(F.col("rows_quarantined") > F.col("rows_processed") * 0.15, F.lit("too many rejected rows")),
    )
    running = runlog.started(runs)
    return running.unionByName(runlog.finished(running, results))


@_query
def run_events(w):
    return _run_log(w)


@_query
def run_history(w):
    return runlog.history(_run_log(w))


@_query
def run_latest(w):
    return runlog.latest(_run_log(w))


@_query
def run_last(w):
    return runlog.last_run(_run_log(w))


@_query
def run_success_rate(w):
    return runlog.success_rate(_run_log(w))


@_query
def run_metrics(w):
    return runlog.metrics(w["clean_report"], 1, w.as_of)


@_query
def retention_filter(w):
    log = T.quarantine_events(w.source("events"))
    return runlog.retain(log, "timestamp", 30, T.as_of("2024-02-10 08:00:00"))


@_query
def quarantine_alert(w):
    return runlog.quarantine_alert(T.quarantine_events(w.source("events")), T.as_of("2024-01-30 23:30:00"))


# --- features, forecast, models -----------------------------------------------------------------
@_query
def pair_sales(w):
    """Units per product, store and day: the input of features and forecast."""
    return features.daily_units(w["fact_sales"], w["dim_product"], w["dim_store"], w["dim_date"])


@_query
def stock_features(w):
    return features.stock_features(w["recent_sales"], w["pair_stock"], w.categories(), w.forecast_day())


@_query
def history_features(w):
    """Features on every day with a stock count: the rows that the models learn from."""
    return features.history_features(w["pair_sales"], w["pair_stock"], w.categories())


@_query
def stock_labels(w):
    return features.with_labels(w["stock_features"])


@_query
def trailing_sales(w):
    return features.trailing_sales(w["pair_sales"])


@_query
def demand_forecast_7d(w):
    return forecast.weekly_forecast(w["recent_sales"], w["stock_features"], w.forecast_day())


@_query
def demand_forecast_daily(w):
    return forecast.daily_forecast(w["recent_sales"], w.stocked_pairs(), w.forecast_day())


@_query
def demand_forecast_trend(w):
    """Next seven days of every stocked pair by weekday levels and a trend."""
    return trend.forecast(w["recent_sales"], w.stocked_pairs(), w.forecast_day())


@_query
def stockout_scores(w):
    """Scores of all stocked pairs by the trained models."""
    return ml.score(w.models(), w["stock_features"])


@_query
def model_checks(w):
    """What must hold of the scores, and whether both models do well on rows they were not fitted on.

    Scores come from models of all rows; those that are measured learn from the rows that are not held out.
    """
    scores, history = w["stock_scores"], w["history_features"]
    measured = ml.quality(w.models(measured=True), history.where(ml.held_out(history)))
    outside = ~F.col("risk_probability").between(0, 1) | ~F.col("ml_confidence").between(0, 100)
    checks = scores.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(F.when(F.col("risk_level").isNull() | F.col("recommended_reorder").isNull(), 1)).alias("n_null"),
        F.count(F.when(outside, 1)).alias("n_out_of_range"),
    )
    good = measured.select((F.col("accuracy") > 0.85).alias("accuracy_above_85_pct"), (F.col("r2") > 0.7).alias("r2_above_0_7"))
    return checks.join(good, F.lit(True))  # one row each


@_query
def risk_ranking(w):
    return ml.risk_ranking(w["stock_scores"])


@_query
def reasoning_log(w):
    return ml.forecast_log(w["stock_scores"], w["pair_sales"], w.forecast_day(), w.as_of)


@_query
def high_risk_latest(w):
    return ml.high_risk(w["reasoning_log"], w["dim_product"], w["dim_store"])


@_query
def recent_predictions(w):
    return ml.recent_predictions(w["reasoning_log"])


@_query
def recent_alerts(w):
    return ml.recent_alerts(w["reasoning_log"])


@_query
def decision_feed(w):
    return ml.decision_feed(w["reasoning_log"], T.as_of(LATER))


# The same reports over scores by a plain rule, which another engine can follow.
SAFETY_STOCK = 20


def _rule_scores(w):
    """Scores by rule: two days' expected demand and the safety stock, against what is there."""
    need = F.col("avg_sales_7d") * 2 + SAFETY_STOCK
    p = need / (need + F.col("current_stock"))
    return w["stock_features"].select(
        *features.PAIR,
        *features.FEATURES,
        p.alias("risk_probability"),
        X.risk_level(p).alias("risk_level"),
        X.round2(p * 100).alias("ml_confidence"),
        F.greatest(need - F.col("current_stock"), F.lit(0.0)).cast("int").alias("recommended_reorder"),
    )


def _rule_log(w):
    return ml.forecast_log(_rule_scores(w), w["pair_sales"], w.forecast_day(), w.as_of)


@_query
def risk_ranking_by_rule(w):
    return ml.risk_ranking(_rule_scores(w))


@_query
def reasoning_log_by_rule(w):
    return _rule_log(w)


@_query
def high_risk_by_rule(w):
    return ml.high_risk(_rule_log(w), w["dim_product"], w["dim_store"])


@_query
def recent_predictions_by_rule(w):
    return ml.recent_predictions(_rule_log(w))


@_query
def recent_alerts_by_rule(w):
    return ml.recent_alerts(_rule_log(w))


@_query
def decision_feed_by_rule(w):
    return ml.decision_feed(_rule_log(w), T.as_of(LATER))


# --- live orders ---------------------------------------------------------------------------------
DELAY = "1 day"


def _events(w):
    # A glob, because a single file is not accepted as a streaming folder.
    return live.read_stream(w.spark, f"{w.sf_dir}/events.parque[t]", w.source("events").schema)


def _orders(w):
    return live.event_time(T.live_orders(_events(w)))


def _local(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@_query
def stream_order_ingest(w):
    return live.run_append(T.live_orders(_events(w)), "live-orders")


@_query
def stream_dedup_orders(w):
    """Every order arrives twice and is kept once."""
    orders = _orders(w)
    twice = orders.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _local(live.run_dedup(twice, "dedup-orders"))


@_query
def stream_daily_metrics(w):
    return live.run_daily_metrics(_orders(w), "daily-metrics")


@_query
def stream_daily_view(w):
    """The running view of the same days, by watermark and update mode."""
    return live.run_updates(live.daily_metrics(_orders(w), DELAY), "daily-view", ["day"]).drop("approx_customers")


@_query
def live_day_metrics(w):
    return live.day_metrics(T.live_orders(w.source("events")), F.lit("2024-01-30").cast("date"))


@_query
def live_totals(w):
    return live.live_totals(T.live_orders(w.source("events")), F.lit("2024-01-30").cast("date"))


@_query
def order_age(w):
    """How long ago each live order came in, as a label."""
    orders = T.live_orders(w.source("events"))
    return orders.select("order_id", X.age_label("timestamp", T.as_of(T.STREAM_AS_OF)).alias("age"))


@_query
def stream_recent_orders(w):
    return live.run_recent(T.live_orders(_events(w)), "recent-orders", 50)


@_query
def recent_orders(w):
    return live.recent(T.live_orders(w.source("events")), 10)


@_query
def stream_alerts(w):
    """Alerts from the trained models."""
    return live.run_alerts(T.live_orders(_events(w)), w["stock_scores"], "alerts")


@_query
def stream_alerts_by_rule(w):
    return live.run_alerts(T.live_orders(_events(w)), stash(_rule_scores(w), "rule-scores"), "alerts-rule")


@_query
def stream_messages(w):
    return live.run_messages(T.live_orders(_events(w)), stash(_rule_scores(w), "rule-scores"), "messages")


@_query
def stream_quarantine_rate(w):
    log = live.event_time(T.quarantine_events(_events(w)))
    return live.run_quarantine_rate(log, "quarantine-rate", threshold=3)
