from conftest import rows

from shelfline.operators import basket


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_baskets_are_dealt_once(spark):
    items = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "r"), ("b", "r"), ("b", "p")], "basket string, product string")
    items = basket.stash(items, "items")
    got = basket.pair_support(items, share=10)
    assert rows(got) == [("p", "q", 1), ("p", "r", 2), ("q", "r", 1)]
    assert "posexplode" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rare_products_leave_without_a_shuffle_of_items(spark):
    items = basket.stash(spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "basket string, product string"), "items")
    support = basket.stash(items.groupBy("product").count().withColumnRenamed("count", "n"), "support")
    kept = basket.frequent_items(items, 2, support)
    assert rows(kept) == [("a", "p"), ("b", "p")]
    assert exchanges(kept) == 0
