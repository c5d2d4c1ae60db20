from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfline.operators.rows import dense_keys, keep_first, salted_join, top_k


def test_dense_keys_equal_a_global_row_number(spark):
    df = spark.range(5000).select(F.concat(F.lit("id"), ((F.col("id") * 7919) % 5000).cast("string")).alias("k"), F.col("id").alias("v"))
    got = dense_keys(df.repartition(7), ["k"], "key")
    want = df.withColumn("key", F.row_number().over(Window.orderBy("k")).cast("long"))
    assert rows(got, "key", "k", "v") == rows(want, "key", "k", "v")


def test_dense_keys_start_and_nulls_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert rows(dense_keys(df, ["k"], "key", 10)) == sorted([(11, "a"), (12, "b"), (13, None)], key=str)
    assert dense_keys(df.where("k = 'none'"), ["k"], "key").count() == 0


def test_keep_first_drops_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    first = keep_first(df, ["k"], [F.desc("id")])
    assert rows(first, "k", "id") == [(0, 999), (1, 997), (2, 998)]
    plan = first._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(keep_first(df, ["k"], [F.asc("v")])) == sorted([(None, 1), ("a", 3)], key=str)


def test_salted_join_equals_plain_join(spark):
    # One key holds most rows; keys without partner and repeated partners are there too.
    left = spark.range(900).select(F.when(F.col("id") < 600, F.lit(1)).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (9, "none")], "k long, w string")
    assert rows(salted_join(left, right, ["k"], 4), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")


def test_top_k(spark):
    df = spark.range(100)
    assert [r[0] for r in top_k(df, [F.desc("id")], 3).collect()] == [99, 98, 97]
    assert top_k(df, [F.desc("id")], None).count() == 100
