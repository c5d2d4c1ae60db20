from datetime import date, datetime

import pytest
from conftest import rows

from shelfline import schemas as S
from shelfline.session import fresh_path, release, scratch, shared_dir, stash
from shelfline.plans import catalog
from shelfline.sources import readers, writers


def test_inventory_is_read_by_position(spark):
    path = fresh_path(spark, "t")
    text = spark.createDataFrame([("ST001", "P0007", "2024-01-05", "42")], "date string, store_id string, product_id string, stock_level string")
    text.write.option("header", True).csv(path)
    assert rows(readers.read_inventory_csv(spark, path), "store_id", "product_id", "date", "stock_level") == [
        ("ST001", "P0007", date(2024, 1, 5), 42)]


def test_ids_keep_leading_zeros(spark):
    path = fresh_path(spark, "t")
    spark.createDataFrame([("007", "n", "c", "2024-01-01")], "store_id string, store_name string, city string, opened_date string").write.option("header", True).csv(path)
    assert readers.read_csv(spark, path, S.raw_schema("stores")).first()["store_id"] == "007"


def test_latest_snapshot_wins(spark):
    folder = fresh_path(spark, "t")
    old, new = spark.createDataFrame([("a", 1)], "id string, v int"), spark.createDataFrame([("a", 2)], "id string, v int")
    writers.write_snapshot(new, folder, "customers", datetime(2024, 2, 1))
    writers.write_snapshot(old, folder, "customers", datetime(2024, 1, 31, 23, 59, 59))
    assert rows(readers.read_latest_snapshot(spark, f"{folder}/customers_*")) == [("a", 2)]
    named = readers.read_snapshots(spark, f"{folder}/customers_*")
    assert rows(named, "v", "snapshot_file") == [(1, "customers_20240131T235959.parquet"), (2, "customers_20240201T000000.parquet")]
    with pytest.raises(FileNotFoundError):
        readers.read_latest_snapshot(spark, f"{folder}/stores_*")


def test_csv_before_parquet_before_error(spark):
    folder = fresh_path(spark, "t")
    df = spark.createDataFrame([("p",)], "a string")
    with pytest.raises(FileNotFoundError):
        readers.read_csv_or_parquet(spark, f"{folder}/x.csv", f"{folder}/x.parquet")
    df.write.parquet(f"{folder}/x.parquet")
    assert readers.read_csv_or_parquet(spark, f"{folder}/x.csv", f"{folder}/x.parquet").first()[0] == "p"
    spark.createDataFrame([("c",)], "a string").write.option("header", True).csv(f"{folder}/x.csv")
    assert readers.read_csv_or_parquet(spark, f"{folder}/x.csv", f"{folder}/x.parquet").first()[0] == "c"


def test_rebuild_and_append(spark):
    path = fresh_path(spark, "t")
    writers.rebuild(spark.range(3), path)
    writers.rebuild(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
    writers.append(spark.range(5), path)
    assert spark.read.parquet(path).count() == 7


def test_row_counts_and_views(spark):
    assert rows(writers.row_counts({"a": spark.range(3), "b": spark.range(0)})) == [("a", 3), ("b", 0)]
    assert readers.register(spark.range(4), "four").count() == 4


def test_work_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named.rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    kept = stash(spark.range(5), "x")
    assert kept.count() == 5 and shared_dir(spark) in kept.inputFiles()[0]


def test_scratch_leaves_only_what_is_kept(spark):
    with scratch(spark):
        gone, kept = stash(spark.range(5), "gone"), stash(spark.range(5), "kept", keep=True)
        assert gone.count() == kept.count() == 5
        paths = [df.inputFiles()[0].rsplit("/", 1)[0] for df in (gone, kept)]
    assert [readers.path_exists(spark, p) for p in paths] == [False, True]


def test_a_query_works_again_after_release(spark, sf_dir):
    query = catalog.queries()["store_counts_by_region"]
    first = rows(query(spark, sf_dir))
    assert release(spark)
    assert rows(query(spark, sf_dir)) == first


def test_release_deletes_only_own_paths(spark):
    path = fresh_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert readers.path_exists(spark, path) and release(spark, path) and not readers.path_exists(spark, path)
    with pytest.raises(ValueError):
        release(spark, shared_dir(spark))
