from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators.increments import Maintained
from shelfline.session import fresh_path
from shelfline.sources.folders import children


def test_only_the_sums_that_are_read_are_kept(spark):
    sales = spark.range(12).select(
        F.col("id").cast("string").alias("sale_id"), F.lit(20240101).alias("date_key"), (F.col("id") % 3).alias("store_key"),
        (F.col("id") % 4).alias("product_key"), F.col("id").alias("customer_key"), F.lit(2).alias("quantity"), F.lit(5.0).alias("revenue"))
    path, every = fresh_path(spark, "one"), Maintained(fresh_path(spark, "all"), fan=2)
    one = Maintained(path, fan=2, names=["by_product"])
    for kept in (one, every):
        kept.apply(0, sales)
        kept.apply(1, sales.limit(0), sales.where("id < 4"))
    assert children(spark, path) == ["by_product"]
    assert rows(one.sums(spark, "by_product", 2)) == rows(every.sums(spark, "by_product", 2))
