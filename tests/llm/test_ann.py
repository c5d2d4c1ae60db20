import numpy as np
from pyspark.sql import functions as F

from shelfline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], SCHEMA)


def brute(rows, query_id, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    s = x @ x[list(ids).index(query_id)]
    best = {}
    for i, v in zip(ids, s, strict=True):
        if i != query_id:
            best[int(i)] = max(best.get(int(i), -np.inf), v)
    return sorted(best, key=lambda i: (-best[i], i))[:k]


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r)
    return out


def test_recall_and_exact_scores(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.4 * draw.normal(size=16)]) for i in range(3000)]
    got = listed(ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, 10, sample=1500))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 11))
        hits += len(set(brute(rows, q, 10)) & {r.vec_id for r in found})
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits / (10 * len(got)) >= 0.9


def test_large_parts_are_split_again(spark):
    """Two levels: more and smaller parts, recall kept, and a query meets few of the rows."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.2 * draw.normal(size=16)]) for i in range(6000)]
    df = frame(spark, rows)
    tree, placed, sizes = ann.index(ann.usable(df), 10, sample=1024, split_rows=600)
    one, _, plain = ann.index(ann.usable(df), 10, sample=1024)
    assert len(one) == 1 and len(plain) == 4 and len(tree) > 2 and len(sizes) == ann.leaf_count(tree) > 10
    assert sum(sizes) == 6000 and placed.where("part is null or part < 0").count() == 0
    assert sizes.max() < plain.max()
    got = listed(ann.nearest(df, F.col("vec_id") % 100 == 0, 10, sample=1024, split_rows=600))
    hits = sum(len(set(brute(rows, q, 10)) & {r.vec_id for r in found}) for q, found in got.items())
    assert hits / (10 * len(got)) >= 0.9 and len(got) == 60
    x = np.array([v for _, v in rows])
    query, leaf = ann.route(tree, ann.probes_of(tree), ann.rows_under(tree, sizes), 11, x[::100])
    assert sizes[leaf].sum() / 60 < 0.7 * 6000
    assert len(set(zip(query, leaf, strict=True))) == len(leaf)


def test_tree_of_parts():
    leaf = {"w": np.eye(2), "b": np.zeros(2)}
    tree = [ann.node(leaf, np.array([0.5, 1.0]), 0, np.arange(2))]
    ann.split(tree, 0, {"w": -np.eye(2), "b": np.zeros(2)}, np.array([1.0, 1.0]))
    x = np.array([[2.0, 1.0], [1.0, 2.0], [1.0, -1.0]])
    assert ann.leaf_count(tree) == 3
    assert list(ann.leaves_of(tree, x)) == [2, 1, 2]
    under = ann.rows_under(tree, np.array([5, 7, 9]))
    assert [list(u) for u in under] == [[14, 7], [5, 9]]
    query, leaves = ann.route(tree, [1, 1], under, 10, x[:1])
    assert sorted(leaves) == [0, 2]  # nine rows are not enough
    assert ann.probes_of(tree) == [2, 1]


def test_small_tables_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (40, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (4, [0.0, 3.0])]
    got = listed(ann.search_every(frame(spark, rows), 20))
    assert list(got) == [20]
    assert [(r.vec_id, r.score) for r in got[20]] == [(1, 1.0), (3, 1.0), (2, 0.5), (4, 0.0)]
    assert ann.search_every(frame(spark, []), 20).count() == 0
    assert ann.search_every(frame(spark, [(20, [1.0])]), 20).count() == 0


def test_many_equal_vectors(spark):
    draw = np.random.default_rng(3)
    same = [float(x) for x in draw.normal(size=8)]
    rows = [(i, same if i % 3 == 0 else [float(x) for x in 0.1 * draw.normal(size=8)]) for i in range(1500)]
    got = listed(ann.nearest(frame(spark, rows), F.col("vec_id") == 300, 20, sample=800))
    assert [r.vec_id for r in got[300]] == list(range(0, 60, 3))


def test_parts_are_balanced():
    draw = np.random.default_rng(4)
    x = ann.unit(draw.normal(size=(1000, 8)))
    own = ann.balanced_parts(x, ann.neighbour_graph(x), 8)
    assert np.bincount(own, minlength=8).max() <= np.ceil(1.1 * 1000 / 8)


def test_queries_are_cut_into_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = lambda rows: sorted(map(tuple, ann.nearest(df, F.lit(True), 5, query_rows=rows).collect()))
    whole, search = found(1 << 20), ann._search

    def bounded(k):
        inner = search(k)

        def run(key, rows, queries):
            assert queries.num_rows < 100
            return inner(key, rows, queries)

        return run

    monkeypatch.setattr(ann, "_search", bounded)
    assert found(40) == whole and len(whole) == 1500


def test_held_out_rows_are_not_fitted(monkeypatch):
    x = np.random.default_rng(4).normal(size=(1024, 8))
    fitted, fit = [], ann.fit_router
    monkeypatch.setattr(ann, "fit_router", lambda rows, *more: fitted.append(len(rows)) or fit(rows, *more))
    ann.learn(x, 10)
    assert fitted == [1024 - 256]
