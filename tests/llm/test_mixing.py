import random
import re

import pytest
from pyspark.sql import functions as F

from shelfline.llm import mixing


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def corpus():
    draw = random.Random(5)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else draw.choice(["a", "B", "é", "z", None])
        rows.append((i, source, " ".join(["w"] * draw.choice([0, 1, 3, 20, 50, 120]))))
    return [*rows, (1, "a", None), (1, "a", None), (2, "solo", "one two"), (None, "a", "x y"), (5000, "hot", "w " * 3000)]


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame([(i, s, t, 4, 1) for i, s, t in corpus()], "doc_id long, source string, text string, k int, size int")
    return df, mixing.mix(df).collect()


def test_targets_sizes_and_takes(mixed):
    _, got = mixed
    rows = corpus()
    assert sorted((r.doc_id, r.source, r["size"]) for r in got if r.doc_id is not None and r.source is not None) == sorted((i, s, len(re.findall(r"\S+", t or ""))) for i, s, t in rows if i is not None and s is not None)
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes, mixing.WEIGHTS)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 for r in own)
        largest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= largest / 2 + 1e-6
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in got)


def test_runs_agree_whatever_the_partitions(mixed):
    df, got = mixed
    again = mixing.mix(df.repartition(7, F.rand(3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_chances_are_fair(spark):
    """With equal sizes, documents are taken about as often as their probability says, early or late."""
    rows = [(i, "s", "w w w") for i in range(600)] + [(10_000 + i, "t", "w w w") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1.0, 2.0), share=1.0).collect()
    by = {s: [r.copies for r in sorted(got, key=lambda r: r.doc_id) if r.source == s] for s in "st"}
    assert abs(sum(by["s"]) - 400) <= 1 and abs(sum(by["t"]) - 800) <= 1
    assert abs(sum(by["s"][:300]) - 200) < 45 and set(by["s"]) == {0, 1} and set(by["t"]) == {1, 2}


def test_empty_and_wordless(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]


def test_no_python_on_the_path(mixed):
    df, _ = mixed
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_many_equal_rows_are_numbered_by_several_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 16)
    df = spark.createDataFrame([(None, "a", "x y z")] * 500 + [(1, "a", "v w")] * 17 + [(2, None, "u")], "doc_id long, source string, text string").repartition(4)
    groups = df.selectExpr("doc_id AS id", "source", "3L AS size").groupBy("id", "source", "size").agg(F.count("*").alias("copies"))
    numbered = mixing._numbered(groups)
    assert sorted((r.id or 0, r.k) for r in numbered.collect()) == sorted([(0, k) for k in range(1, 501)] + [(1, k) for k in range(1, 18)] + [(2, 1)])
    got = mixing.mix(df).collect()
    assert len(got) == 518 and {r.copies for r in got if r.doc_id is None} <= {1, 2}
    for source in ("a", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1.5
