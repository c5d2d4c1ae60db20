from datetime import date

import pytest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfline.operators import features, ml
from shelfline.plans.warehouse import Warehouse


def described(spark, n, stock, mean):
    return spark.range(n).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"), F.lit("s1").alias("store_id"), F.lit(date(2024, 1, 1)).alias("date"),
        stock.cast("double").alias("current_stock"), mean.cast("double").alias("avg_sales_7d"),
        (F.col("id") % 5).cast("double").alias("stddev_sales_7d"), (F.col("id") % 3).cast("int").alias("category_encoded"))


def binner(rows):
    ends = [[float("-inf"), *(edges or [0.0]), float("inf")] for edges in ml.bin_edges(rows)]
    return Bucketizer(splitsArray=ends, inputCols=features.FEATURES, outputCols=ml.BINNED)


def test_models_learn_from_rows_of_any_hash(spark):
    f = described(spark, 45_000, F.col("id") % 7, F.col("id") % 11)
    # Pairs that sell much are those with large hashes: about half, none of them among the 20,000 smallest.
    f = f.withColumn("avg_sales_7d", F.when(F.xxhash64("product_id", "store_id", "date") > 0, F.lit(500.0)).otherwise(F.col("avg_sales_7d")))
    rows = ml.training_rows(f)
    assert rows.count() == 45_000
    scores = ml.score(ml.fit(rows, trees=5, rounds=20), f).where("avg_sales_7d = 500")
    lowest = scores.agg(F.min("recommended_reorder"), F.min("risk_probability")).first()
    assert lowest[0] > 800 and lowest[1] > 0.8


def test_every_row_counts_in_its_bins(spark):
    f = described(spark, 30_000, F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id") * 37 % 997), F.col("id") * 53 % 1009 / 7)
    rows = ml.training_rows(f)
    seen = ml.binned_rows(rows, binner(rows))
    got = seen.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("risk")).alias("risk"), F.sum(F.col("n") * F.col("reorder_qty")).alias("reorder")).first()
    want = rows.agg(F.count("*").alias("n"), F.sum("risk").alias("risk"), F.sum("reorder_qty").alias("reorder")).first()
    assert got["n"] == want["n"] == 29_700 and got["risk"] == want["risk"] > 0 and got["reorder"] == pytest.approx(want["reorder"])


def test_boosting_means_of_bins_is_boosting_all_rows(spark):
    f = described(spark, 3_000, F.col("id") * 37 % 97, F.col("id") * 53 % 101 / 7)
    rows = ml.training_rows(f)
    models = ml.fit(rows, trees=2, depth=3, rounds=10)
    each = VectorAssembler(inputCols=ml.BINNED, outputCol="features").transform(binner(rows).transform(rows))
    plain = GBTRegressor(labelCol="reorder_qty", featuresCol="features", maxIter=10, maxDepth=3, maxBins=1024, seed=ml.SEED).fit(each.select("features", "reorder_qty"))
    ours = models.regressor.transform(rows.select(*features.FEATURES)).select("features", F.col("prediction").alias("ours"))
    assert plain.transform(ours).agg(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0] < 1e-6


def test_bins_of_few_many_and_hot_values(spark):
    hot = F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id"))
    stock, mean, deviation, category = ml.bin_edges(described(spark, 20_000, F.col("id") - 10_000, hot))
    assert deviation == [0.5, 1.5, 2.5, 3.5] and category == [0.5, 1.5]
    assert len(stock) == ml.BINS - 1 and stock == sorted(set(stock))
    ends = [-10_000, *stock, 10_000]
    assert max(b - a for a, b in zip(ends, ends[1:])) < 1.2 * 20_000 / ml.BINS  # about equally many rows each
    assert len(mean) > ml.BINS // 2 and mean[0] > 0  # zero fills one bin, the tenth that is not zero has the others
    assert ml.bin_edges(described(spark, 10, F.lit(4), F.lit(0)))[:2] == [[], []]


def test_scores_learn_from_all_rows_and_measured_models_from_those_not_held_out(spark, monkeypatch):
    f = described(spark, 25_000, F.col("id") % 7, F.col("id") % 11)
    w = Warehouse(spark, "/nowhere")
    w._built["history_features"] = f
    monkeypatch.setattr(ml, "fit", lambda rows: rows.count())
    kept = f.where(ml.held_out(f)).count()
    assert 0 < kept < 25_000
    assert (w.models(), w.models(measured=True)) == (25_000, 25_000 - kept)
