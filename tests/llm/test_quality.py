import random
import zlib

import numpy as np
import pytest

from shelfline.llm import quality


def test_linear_time_identity():
    draw = np.random.default_rng(0)
    model = {"w0": 0.3, "w": draw.normal(size=50), "v": draw.normal(size=(50, 4))}
    columns, weights, bounds = draw.integers(0, 50, 12), draw.normal(size=12), np.array([0, 5, 6, 12])
    got = quality.raw_score(model, columns, weights, bounds)
    for r in range(3):
        own = range(bounds[r], bounds[r + 1])
        want = model["w0"] + sum(model["w"][columns[i]] * weights[i] for i in own)
        want += sum(model["v"][columns[i]] @ model["v"][columns[j]] * weights[i] * weights[j] for i in own for j in own if i < j)
        assert abs(got[r] - want) < 1e-9


def corpus():
    draw = random.Random(4)
    good = lambda: " ".join(draw.choices(["river", "stone", "Garden,", "walks", "slowly.", "under", "light"], k=draw.randrange(5, 60)))
    bad = lambda: "!! ".join(draw.choices(["BUY", "NOW", "CHEAP", "$$$", "CLICK"], k=draw.randrange(5, 60)))
    docs, labels = [], []
    for i in range(400):
        label = int(draw.random() < 0.7)
        docs.append((i, good() if label else bad()))
        labels.append((i, label))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(1000, None), (1001, ""), (1002, "word " * 40_000), (None, "no id"), (7, docs[7][1])]
    labels += [(None, 1), (3, None), (2000, 0), (5, 7)]
    return (
        spark.createDataFrame([(i, t, "zz", 0.5) for i, t in docs], "doc_id long, text string, lang string, score double"),
        spark.createDataFrame([(i, q, 1, "clash") for i, q in labels], "doc_id long, quality int, toxic int, text string"),
        dict(labels),
    )


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 405
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400 and truth[r.doc_id] in (0, 1)]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    twins = [r.score for r in got if r.doc_id == 7]
    assert twins[0] == twins[1]


def test_keep_takes_whole_rows(tables):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    good = sorted(str(r.doc_id) for r in quality.score(docs, model).where("predicted = 1").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == good


def test_without_labels_or_rows(tables):
    docs, labels, _ = tables
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    one = quality.train(docs, labels.where("quality = 1"))
    assert len({round(r.score, 6) for r in quality.score(docs, one).collect()}) == 1
    assert quality.score(docs.limit(0), one).count() == 0 and quality.keep(docs.limit(0), one).count() == 0


def test_labels_stay_out_of_scores(tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    model = quality.train(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1)
    assert sorted(r.score for r in quality.score(docs, model).collect()) == sorted(r.score for r in quality.score(other, model).collect())
