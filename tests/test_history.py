from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.operators.history import History
from shelfline.operators.increments import Maintained
from shelfline.operators.registry import KeyRegistry
from shelfline.plans import kpi
from shelfline.session import fresh_path
from shelfline.sources.folders import children, remove

SPEC = "customer_id string, name string, email string, phone string, city string, extra int"
TIMES = [datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1), datetime(2024, 4, 1)]
# Cities of each customer at the four times; absent where there is no entry.
CITIES = {
    "same": ["A", "A", "A", "A"], "moves": ["A", "B", "C", "D"], "returns": ["A", "B", "A", "A"], "gap": ["A", "-", "B", "-"], "late": ["-", "-", "A", "B"],
    "early": ["A", "-", "-", "-"], "null": [None, "", None, "A"], "back": ["A", "A", "B", "A"],
}


def snapshot(spark, at):
    data = [(c, f"{c}{at}", f"{c}@x", None, cities[at], 1) for c, cities in CITIES.items() if cities[at] != "-"]
    return spark.createDataFrame([*data, (None, "n", "e", "p", "A", 1), ("same", "zz", "zz", "zz", "Z", 1)], SPEC)


def expected():
    out = []
    for c, cities in CITIES.items():
        runs = []
        for at, city in enumerate(cities):
            if city != "-" and (not runs or (city or "") != (runs[-1][1] or "")):
                runs.append((at, city))
        for version, (at, city) in enumerate(runs, 1):
            until = TIMES[runs[version][0]] if version < len(runs) else None
            out.append((c, f"{c}{at}", city, TIMES[at], until, until is None, version))
    return sorted(out, key=str)


def content(history):
    return rows(history.table(), "customer_id", "name", "city", "valid_from", "valid_to", "is_current", "version")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 2, 0), (2, 0, 3, 1)])
def test_any_order_gives_one_history(spark, order):
    history = History(spark, fresh_path(spark, "h"), buckets=4)
    for at in order:
        history.apply(snapshot(spark, at), TIMES[at])
    assert content(history) == expected()
    keys = [r.customer_key for r in history.table().collect()]
    assert None not in keys and len(set(keys)) == len(keys)
    assert history.apply(snapshot(spark, order[0]), TIMES[order[0]]) == []  # once more: nothing changes
    assert content(history) == expected()


def test_untouched_buckets_keep_their_files(spark):
    history = History(spark, fresh_path(spark, "h"), buckets=16)
    data = [(f"c{i}", "n", "e", "p", "A", 1) for i in range(200)]
    assert history.apply(spark.createDataFrame(data, SPEC), TIMES[0]) == list(range(16))
    before = history._current()
    keys = {r.customer_id: r.customer_key for r in history.table().collect()}
    moved = [(c, n, e, p, "B" if c == "c5" else city, x) for c, n, e, p, city, x in data]
    touched = history.apply(spark.createDataFrame(moved, SPEC), TIMES[1])
    assert len(touched) == 1
    after = history._current()
    assert {b for b in after if after[b] != before[b]} == set(touched)
    assert children(spark, f"{history.folder}/rows/generation=1") == ["_SUCCESS", f"bucket={touched[0]}"]
    now = history.table().where("version = 1").collect()
    assert {r.customer_id: r.customer_key for r in now} == keys and history.table().count() == 201


def test_an_unfinished_step_is_not_seen(spark):
    history = History(spark, fresh_path(spark, "h"), buckets=2)
    history.apply(snapshot(spark, 0), TIMES[0])
    before = content(history)
    history.apply(snapshot(spark, 1), TIMES[1])
    whole = content(history)
    for name in children(spark, f"{history.folder}/marks"):
        if name.startswith("1-"):
            remove(spark, f"{history.folder}/marks/{name}")
    assert content(history) == before
    history.apply(snapshot(spark, 1), TIMES[1])
    assert content(history) == whole


def test_empty_snapshot(spark):
    history = History(spark, fresh_path(spark, "h"), buckets=2)
    assert history.apply(snapshot(spark, 0).limit(0), TIMES[0]) == [] and history.table().count() == 0


def test_registry_keeps_keys(spark):
    ids = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    keys = KeyRegistry(spark, fresh_path(spark, "k"), ids, "k", buckets=4, block=8)
    first = spark.range(500).selectExpr("concat('x', id % 250) a", "int(id % 2) b", "id as other")
    one = keys.assign(first)
    assert one.count() == 500 and one.select("k").distinct().count() == 250
    before = rows(one.select("a", "b", "k").distinct())
    more = spark.range(900).selectExpr("concat('x', id) a", "int(id % 2) b").unionByName(spark.createDataFrame([(None, 1), ("x1", None)], "a string, b int"))
    two = keys.assign(more.repartition(7))
    assert two.where("a is null or b is null").where("k is not null").count() == 0
    after = {(r.a, r.b): r.k for r in two.where("k is not null").collect()}
    assert len(set(after.values())) == 900
    assert all(after[a, b] == k for a, b, k in before if (a, b) in after)
    again = KeyRegistry(spark, keys.folder, ids, "k", buckets=4, block=8)
    assert again.register(more) == 0 and again.known().count() == len({*after} | {(a, b) for a, b, _ in before})
    assert keys.known([0]).count() < keys.known().count()


def test_registry_numbers_in_blocks_of_tasks(spark):
    """One natural key after the other fills a task's block, then the next of its blocks; no two tasks share one."""
    ids = T.StructType([T.StructField("a", T.LongType())])
    keys = KeyRegistry(spark, fresh_path(spark, "k"), ids, "k", buckets=2, block=16)
    keys.register(spark.range(2000).select(F.col("id").alias("a")))
    numbers = sorted(r.k for r in keys.known().collect())
    assert len(set(numbers)) == 2000 and numbers[0] == 1
    plan = keys.assign(spark.range(2000).select(F.col("id").alias("a")))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


FACT = "sale_id string, date_key int, customer_key long, product_key int, store_key long, quantity int, revenue decimal(18,4), discount decimal(18,4)"


def sale(i, customer=None):
    from decimal import Decimal

    return (f"s{i}", 20240101 + i % 28, i % 6 if customer is None else customer, i % 5, i % 3, i % 4 + 1, Decimal(i) / 4, None)


def test_maintained_sums_equal_a_full_scan(spark):
    """Loads, a correction and a removal over several merges; a customer whose only sale goes is not counted any more."""
    base, second, gone = [sale(i) for i in range(40)], [sale(i) for i in range(40, 70)], [sale(100, 77), sale(101)]
    kept = Maintained(fresh_path(spark, "m"), fan=2)
    frame = lambda data: spark.createDataFrame(data, FACT)
    kept.apply(0, frame(base + gone))
    kept.apply(1, frame(second))
    kept.apply(2, frame([]), frame(gone))
    kept.apply(3, frame([sale(70)]), frame([sale(3)]))
    kept.apply(3, frame([sale(70)]), frame([sale(3)]))  # the same load once more
    fact = frame([r for r in base + second + [sale(70)] if r[0] != "s3"])
    for name, key in (("by_day", "date_key"), ("by_store", "store_key"), ("by_product", "product_key")):
        columns = [key, "_rev", "_n_rev", "_n", "_units"]
        assert rows(kept.sums(spark, name, 4), *columns) == rows(kpi._first_sums(fact, key), *columns)
    assert rows(kpi.summary_of(kept.members(spark, 4))) == rows(kpi.summary(fact))
    assert kept.broken(spark, 4).count() == 0
    kept.apply(4, frame([]), frame([sale(500, 500)]))
    assert {("members", 500)} <= {(r["state"], r["key"]) for r in kept.broken(spark, 5).collect()}
