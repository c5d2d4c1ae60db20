import hashlib
import re

import numpy as np
import pytest

from shelfline.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, own = set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(size, len(p))
            for j in range(len(p) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == p[j : j + n]:
                        hit.update(range(k, k + n))
                        own.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"), (2, "one two three"), (3, "Überraschung"), (10, "the lazy dog near the old river bank at dawn today"), (4, None), (5, "..."),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "two three four five six seven eight nine ten eleven twelve"),
]
DOCS = [
    (1, "x THE quick, brown fox jumps over the lazy dog near the old river bank at dawn y"), (2, "the quick brown fox jumps over the lazy"), (3, "One-two-three one two three"), (4, "eine überraschung, Überraschung"), (5, None), (6, ""),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota"), (8, "kappa"), (9, "so alpha beta gamma delta epsilon zeta eta theta iota kappa"), (9, "so alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "one two three " * 2000),
]


@pytest.mark.parametrize(("shard_bytes", "most_bits"), [(16 << 20, 1 << 28), (50, 1 << 28), (100, 1 << 6)])
def test_matches_brute_force(spark, shard_bytes, most_bits):
    """Small shards, and a bitmap so full that it marks nearly all documents, give the same result."""
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in DOCS], "doc_id long, text string, row int, hit string")
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = decontaminate.report(docs, items, shard_bytes=shard_bytes, most_bits=most_bits)
    found = {r.doc_id: r for r in got.collect()}
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(DOCS, ITEMS)
    assert (found[1].longest_match, found[1].match_item, found[1].match_start) == (16, "1", 1)
    kept = decontaminate.clean(docs, items, shard_bytes=shard_bytes, most_bits=most_bits)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.report(docs, items.limit(0)).collect())
    assert decontaminate.clean(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_windows_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.report(docs, items).collect())


def test_longest_match_ties_by_place_then_item():
    sizes = np.array([3, 3])
    names = ["b", "a", "c"]
    pairs = [(5, 0, 0, 0), (5, 0, 1, 4), (6, 1, 0, 1), (6, 1, 1, 5), (1, 0, 2, 0), (2, 1, 2, 7)]
    assert decontaminate.longest(pairs, sizes, names) == (-4, 5, "a")


def test_random_tables_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    text = lambda n: " ".join(draw.choice(list("abc"), n))
    items = [(int(draw.integers(12)), text(int(draw.integers(0, 25)))) for _ in range(30)]
    docs = [(i, text(int(draw.integers(0, 60)))) for i in range(80)] + [(i, items[0][1]) for i in range(80, 120)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=300)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(docs, items)


def test_plan_does_not_grow_with_the_benchmark(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    size = lambda n: decontaminate.report(docs, spark.createDataFrame([(i, f"item {i} " + "w" * 5000) for i in range(n)], "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert size(1) == size(500) == 1


def test_no_shard_holds_more_than_its_share(spark):
    """A third of all rows equal, with a null id: shards are cut by size, whatever the keys."""
    docs = spark.createDataFrame([(None, "so one two three")] * 300 + [(i, "one two three") for i in range(600)], "doc_id long, text string").coalesce(2)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = docs.selectExpr("struct(doc_id, text) row")
    shared = spark.sparkContext.broadcast(decontaminate.bitmap(decontaminate.test_windows(items)))
    marked = rows.mapInArrow(decontaminate._mark(shared, 160), "row struct<doc_id: long, text: string>, shard long, codes array<long>")
    sizes = [r["count"] for r in marked.groupBy("shard").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 13
    assert decontaminate.clean(docs, items).count() == 0
