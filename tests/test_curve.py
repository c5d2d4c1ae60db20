import glob
import random

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import curve
from shelfline.session import fresh_path


def groups_met(path, **wanted):
    """(row groups whose bounds hold the wanted ranges, all row groups)."""
    met = total = 0
    for name in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            bounds = {c: meta.row_group(g).column(at[c]).statistics for c in wanted}
            total += 1
            met += all(b.min <= high and b.max >= low for c, (low, high) in wanted.items() for b in [bounds[c]])
    return met, total


@pytest.fixture(scope="module")
def sales(spark):
    draw = random.Random(2)
    return spark.createDataFrame([(draw.randrange(1, 400), draw.randrange(1, 60), draw.randrange(365), i) for i in range(60_000)], "product_key long, store_key long, day int, revenue int").persist()


def test_interleaved_bits(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (5, 3), (65_535, 65_535), (40_000, 12_345)], "a long, b long")
    for r in df.select("a", "b", curve.interleaved([F.col("a"), F.col("b")]).alias("z")).collect():
        assert r.z == sum((r.a >> k & 1) << (2 * k + 1) | (r.b >> k & 1) << (2 * k) for k in range(16))
    with pytest.raises(ValueError):
        curve.interleaved([F.lit(0)] * 4)


def test_a_product_store_filter_reads_few_row_groups(spark, sales):
    """Against rows in date order, of which every row group holds all products and stores."""
    by_curve, by_day = fresh_path(spark, "curve"), fresh_path(spark, "by-day")
    curve.write_along_curve(sales, by_curve, ["product_key", "store_key"], 64)
    sales.repartitionByRange(64, "day").sortWithinPartitions("day").write.parquet(by_day)
    for wanted in ({"product_key": (37, 37), "store_key": (12, 12)}, {"product_key": (100, 120), "store_key": (1, 8)}):
        met, total = groups_met(by_curve, **wanted)
        assert total >= 60 and met <= 8
        assert groups_met(by_day, **wanted)[0] > 0.9 * groups_met(by_day, **wanted)[1]
    assert groups_met(by_curve, product_key=(37, 37))[0] <= total / 4
    assert groups_met(by_curve, store_key=(12, 12))[0] <= total / 4
    cond = "product_key between 100 and 120 and store_key <= 8"
    assert rows(spark.read.parquet(by_curve).where(cond)) == rows(sales.where(cond))
    assert spark.read.parquet(by_curve).count() == sales.count()
    meta = pq.ParquetFile(glob.glob(f"{by_curve.removeprefix('file:')}/*.parquet")[0]).metadata
    assert meta.num_rows > 0


def test_hot_place_and_nulls(spark):
    """A third of the rows at one place are dealt over several tasks; nulls stand at the start."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("product_key"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 > 0, F.col("id") % 50).alias("store_key"), "id")
    parts = curve.along_curve(df, ["product_key", "store_key"], 16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 9000 and max(r["count"] for r in parts) < 1500
    assert curve.along_curve(df.limit(0), ["product_key", "store_key"], 4).count() == 0
