"""Stock-out classifier, reorder regressor, scores for all pairs and the reports on them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.operators import forecast
from shelfline.operators.features import FEATURES, PAIR, with_labels
from shelfline.operators.rows import keep_first, top_k
from shelfline.session import stash

# Trees and depth of the forest, rounds and depth of the boosting.
N_TREES, DEPTH = 50, 12
ROUNDS, ROUND_DEPTH = 100, 3
SEED = 42
# Trees tell at most so many bins of a feature apart, whose edges come from the values of all rows.
BINS = 32
BINNED = [f"{c}_bin" for c in FEATURES]
# Equal rows in these bins are drawn in at most so many pieces of equal weight.
PIECES = 8
# With so many bins allowed, Spark's trees look at all rows for their splits: never more than 2 * PIECES * BINS ** 4.
MAX_BINS = 4 * BINS * BINS
# Weighted rows that one task of training holds.
PART_ROWS = 20_000


class Models(NamedTuple):
    classifier: PipelineModel
    regressor: PipelineModel


def training_rows(features: DataFrame, limit: int | None = None) -> DataFrame:
    """Labelled rows for ``fit``: all of them, or the ``limit`` with the smallest hashes if the caller names one."""
    rows = with_labels(features).dropna(subset=FEATURES)
    if limit is None:
        return rows
    key = [c for c in ("product_id", "store_id", "date") if c in features.columns]
    return rows.orderBy(F.xxhash64(*key), *key).limit(limit)


def held_out(features: DataFrame) -> Column:
    """True for a fifth of all rows, by hash of their key."""
    key = [c for c in ("product_id", "store_id", "date") if c in features.columns]
    return F.pmod(F.xxhash64(F.lit("held out"), *key), F.lit(5)) == 0


def _short(value: Column) -> Column:
    """``value`` cut to 16 binary digits, which keeps the order and leaves few distinct values of any number of rows."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - 15)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / step) * step)


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` inner edges per feature, from the counts of its values in all rows.

    Up to ``bins`` values get a bin each; of more, bins hold about equally many rows, where a value counts for one bin at most.
    """
    values = F.array(*(F.struct(F.lit(i).alias("feature"), _short(X.dbl(c)).alias("value")) for i, c in enumerate(FEATURES)))
    counts = rows.select(F.inline(values)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    # One row per short value reaches these windows.
    every = Window.partitionBy("feature")
    upward = every.orderBy("value")
    placed = (
        counts.withColumn("_values", F.count(F.lit(1)).over(every))
        .withColumn("n", F.least("n", F.ceil(F.sum("n").over(every) / bins)))
        .withColumn("_before", F.sum("n").over(upward) - F.col("n"))
        .withColumn("_share", F.floor(F.col("_before") * bins / F.sum("n").over(every)))
        .withColumn("_bin", F.when(F.col("_values") <= bins, F.row_number().over(upward)).otherwise(F.col("_share")))
        .withColumn("_edge", F.when(F.lag("_bin").over(upward) != F.col("_bin"), (F.lag("value").over(upward) + F.col("value")) / 2))
    )
    found = placed.where(F.col("_edge").isNotNull()).select("feature", "_edge").collect()
    return [sorted(r["_edge"] for r in found if r["feature"] == i) for i in range(len(FEATURES))]


def binned_rows(rows: DataFrame, binner: Bucketizer) -> DataFrame:
    """All labelled rows as bins of the features and class, their number and mean reorder.

    Trees tell rows of equal bins apart by their class only, so these are at most 2 * BINS ** 4 rows for any number of them.
    """
    binned = binner.transform(rows.select(*(X.dbl(c).alias(c) for c in FEATURES), X.dbl("risk").alias("risk"), "reorder_qty"))
    total = F.sum(F.col("reorder_qty").cast("decimal(28,9)"))  # sums do not depend on row order
    return binned.groupBy(*BINNED, "risk").agg(F.count(F.lit(1)).alias("n"), (X.dbl(total) / F.count(F.lit(1))).alias("reorder_qty"))


def fit(rows: DataFrame, trees: int = N_TREES, depth: int = DEPTH, rounds: int = ROUNDS, round_depth: int = ROUND_DEPTH, seed: int = SEED) -> Models:
    """Train both models on all labelled rows (``training_rows``).

    The rows are read twice, for the edges of the bins and for the rows per bin. Training reads the latter many times,
    so they are written once. Boosting fits means by number of rows, which gives the trees of all rows; the forest draws
    each row by itself where less than ``PIECES`` are equal, more in that many pieces.
    """
    binary = {"ml_attr": {"type": "nominal", "num_vals": 2}}
    ends = [[float("-inf"), *(edges or [0.0]), float("inf")] for edges in bin_edges(rows)]
    binner = Bucketizer(splitsArray=ends, inputCols=FEATURES, outputCols=BINNED)
    vector = VectorAssembler(inputCols=BINNED, outputCol="features")
    seen = stash(binned_rows(rows, binner), "training-rows")
    # The same rows in the same order on every cluster, since drawing goes by place.
    dealt = seen.repartition(1 + seen.count() // PART_ROWS, *BINNED).sortWithinPartitions(*BINNED, "risk")
    dealt = vector.transform(dealt.withColumn("risk", F.col("risk").alias("risk", metadata=binary)).withColumn("n", X.dbl("n")))
    drawn = F.least(F.col("n"), F.lit(float(PIECES)))
    pieces = dealt.withColumn("n", F.explode(F.array_repeat(F.col("n") / drawn, drawn.cast("int"))))
    forest = RandomForestClassifier(labelCol="risk", featuresCol="features", weightCol="n", numTrees=trees, maxDepth=depth, maxBins=MAX_BINS, seed=seed)
    boosting = GBTRegressor(labelCol="reorder_qty", featuresCol="features", weightCol="n", maxIter=rounds, maxDepth=round_depth, maxBins=MAX_BINS, seed=seed)
    return Models(
        PipelineModel([binner, vector, forest.fit(pieces.select("features", "risk", "n"))]),
        PipelineModel([binner, vector, boosting.fit(dealt.select("features", "reorder_qty", "n"))]),
    )


def quality(models: Models, features: DataFrame) -> DataFrame:
    """One row: accuracy of the classifier, R2 of the regressor and the rows they were measured on."""
    # Labels follow from the features, so equal features count by their number of rows.
    rows = with_labels(features.dropna(subset=FEATURES).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("_n")))
    risk = models.classifier.transform(rows).select("risk", F.col("prediction").alias("guess"), "reorder_qty", "_n", *FEATURES)
    both = models.regressor.transform(risk)
    error, value, n = F.col("reorder_qty") - F.col("prediction"), F.col("reorder_qty"), F.col("_n")
    return both.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"),
        X.ratio(F.sum(F.when(F.col("risk") == F.col("guess"), n).otherwise(0)), F.sum(n)).alias("accuracy"),
        (1 - F.sum(n * error * error) / (F.sum(n * value * value) - F.sum(n * value) * F.sum(n * value) / F.sum(n))).alias("r2"),
    )


def score(models: Models, features: DataFrame) -> DataFrame:
    """Probability, risk level, confidence in percent and whole reorder units for every pair.

    Equal features score equally, so the trees see each distinct row of them once: far fewer than pairs. Those are
    written when called, so that the join back to all pairs is planned by their size.
    """
    rows = features.dropna(subset=FEATURES)
    own = [*BINNED, "features", "rawPrediction", "probability", "prediction"]
    with_risk = models.classifier.transform(rows.select(*FEATURES).distinct()).withColumn(
        "risk_probability", vector_to_array("probability")[1]
    ).drop(*own)
    guessed = models.regressor.transform(with_risk).withColumn("recommended_reorder", F.col("prediction").cast("int"))
    scored = rows.join(stash(guessed.drop(*own), "distinct-scores"), FEATURES)
    return scored.select(
        *PAIR,
        *FEATURES,
        "risk_probability",
        X.risk_level("risk_probability").alias("risk_level"),
        X.round2(F.col("risk_probability") * 100).alias("ml_confidence"),
        "recommended_reorder",
    )


def risk_ranking(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest risk first, by the order of the levels and not of their names."""
    columns = [*PAIR, "risk_level", F.round("ml_confidence", 1).alias("confidence_pct"), "recommended_reorder"]
    ordered = scores.select(*columns, X.risk_ordinal("risk_level").alias("risk_rank"))
    return top_k(
        ordered,
        [F.desc_nulls_last("risk_rank"), F.desc_nulls_last("confidence_pct"), *[F.asc_nulls_last(c) for c in PAIR]],
        limit,
    )


_BOUNDS = {
    "forecast_7d": "prophet_7d_forecast",
    "upper_bound": "prophet_upper_bound",
    "lower_bound": "prophet_lower_bound",
    "days_remaining": "days_remaining_forecast",
}


def reasoning_log(scores: DataFrame, forecasts: DataFrame, as_of: Column) -> DataFrame:
    """One explained prediction per pair; risk level as 0 (Low) to 3 (Critical)."""
    bounds = forecasts.select(*PAIR, *_BOUNDS).withColumnsRenamed(_BOUNDS)
    return _explained(scores.join(bounds, PAIR, "left"), as_of)


def forecast_log(scores: DataFrame, daily: DataFrame, last_day: Column, as_of: Column) -> DataFrame:
    """``reasoning_log`` over the weekly forecast of the scored pairs.

    The forecast is made beside the scores, so only pairs with recent sales are joined and never all pairs with all.
    """
    keep = [c for c in scores.columns if c not in (*PAIR, "current_stock")]
    both = forecast.weekly_forecast(daily, scores, last_day, keep=keep)
    return _explained(both.withColumnsRenamed(_BOUNDS), as_of)


def _explained(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.select(
        as_of.alias("timestamp"),
        "store_id",
        "product_id",
        "current_stock",
        "avg_sales_7d",
        X.ratio("stddev_sales_7d", "avg_sales_7d").alias("demand_volatility_cv"),
        "prophet_7d_forecast",
        "prophet_upper_bound",
        "prophet_lower_bound",
        "days_remaining_forecast",
        X.risk_ordinal("risk_level").alias("risk_level"),
        F.col("risk_probability").alias("ml_confidence"),
        F.col("recommended_reorder").alias("optimal_reorder_qty"),
    )


def latest_predictions(log: DataFrame) -> DataFrame:
    return keep_first(log, PAIR, [F.desc_nulls_last("timestamp")])


def high_risk(log: DataFrame, dim_product: DataFrame, dim_store: DataFrame, limit: int = 20) -> DataFrame:
    """Latest High or Critical predictions, least days of stock first.

    dim_product: product_id, name; dim_store: store_id, store_name.
    """
    named = (
        latest_predictions(log)
        .where(F.col("risk_level") >= 2)
        .join(dim_product.select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(dim_store.select("store_id", "store_name"), "store_id")
    )
    columns = [
        "store_id", "product_id", "product_name", "store_name", "current_stock", "prophet_7d_forecast",
        "days_remaining_forecast", "risk_level", "ml_confidence", "optimal_reorder_qty",
    ]
    order = [F.asc_nulls_last("days_remaining_forecast"), F.asc_nulls_last("product_id"), F.asc_nulls_last("store_id")]
    return top_k(named.select(*columns), order, limit)


def recent_predictions(log: DataFrame, limit: int = 50) -> DataFrame:
    order = [F.desc_nulls_last("timestamp"), F.asc_nulls_last("product_id"), F.asc_nulls_last("store_id")]
    return top_k(log.select("timestamp", "store_id", "product_id", "risk_level", "ml_confidence"), order, limit)


def recent_alerts(log: DataFrame, limit: int = 5) -> DataFrame:
    """Newest High and Critical predictions."""
    columns = ["product_id", "store_id", "risk_level", "ml_confidence", "optimal_reorder_qty", "timestamp"]
    order = [F.desc_nulls_last("timestamp"), F.asc_nulls_last("product_id"), F.asc_nulls_last("store_id")]
    return top_k(log.where(F.col("risk_level") >= 2).select(*columns), order, limit)


def decision_feed(log: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Predictions as proposed actions; High and Critical ones wait for a person."""
    feed = log.select(
        F.concat_ws("-", F.date_format("timestamp", "yyyyMMddHHmmss"), "product_id", "store_id").alias("decision_id"),
        "timestamp",
        F.lit("Stockout Risk").alias("decision_type"),
        F.concat_ws("", F.lit("Product "), "product_id", F.lit(" at Store "), "store_id").alias("entity"),
        F.concat_ws("", F.lit("Reorder "), F.col("optimal_reorder_qty").cast("string"), F.lit(" units")).alias("action"),
        F.col("ml_confidence").alias("confidence"),
        F.concat_ws("", F.lit("Risk Level: "), F.col("risk_level").cast("string")).alias("impact"),
        F.when(F.col("risk_level") >= 2, F.lit("pending")).otherwise(F.lit("executed")).alias("status"),
        X.age_label("timestamp", as_of).alias("age"),
    )
    return top_k(feed, [F.desc_nulls_last("timestamp"), F.asc_nulls_last("decision_id")], limit)
