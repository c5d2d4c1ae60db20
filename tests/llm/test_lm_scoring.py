import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfline.llm import lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def corpus(n=150):
    draw = random.Random(8)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("en", "de", "fr")]
    rows = [(i, " ".join(draw.choices(tongues[i % 3], k=60))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "EN1\tEn2\nen3 \x1f rareé"), (n + 2, "EN1\tEn2\nen3 \x1f rareé"), (None, "en1 de1")]


def test_counts_and_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 3, True) for i, t in rows], "doc_id long, text string, chunk int, held_out boolean").repartition(5)
    got = lm_scoring.report(df, spread=16).collect()
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows), key=str,
    )
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)  # the word before tells the language
    twins = [r.score for r in got if r.doc_id == 152]
    assert len(twins) == 2 and twins[0] == twins[1]


def complete(model):
    """The model with what scoring needs, and log10 P of all pairs."""
    size = len(model["b"])
    model = model | {"ahead": model["R"] @ model["C"], "log_z": lm_scoring.log_sums(model, 0, size, rows=7)}
    pairs = np.divmod(np.arange(size * size), size)
    return lm_scoring.log_probabilities(model, *pairs, rows=100).reshape(size, size)


def learned(counts, passes=1, **settings):
    model = lm_scoring.start(counts.sum(0))
    learner = lm_scoring.Learner(model, **settings)
    context, token = np.nonzero(counts)
    for _ in range(passes):
        learner.learn(context, token, counts[context, token])
    return model | {"R": learner.R, "C": learner.C, "b": learner.b}


def test_probabilities_are_normalised():
    table = complete(learned(np.random.default_rng(0).poisson(1.0, (40, 40))))
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-4)


def test_untrained_model_is_the_unigram():
    model = lm_scoring.start(np.array([5, 1, 2, 0, 30]))
    table = complete(model | {"R": 0 * model["R"]})
    assert np.allclose(10.0**table, (np.array([5, 1, 2, 0, 30]) + 0.5) / 40.5, atol=1e-6)


def test_training_learns_pairs():
    counts = np.full((30, 30), 1)
    counts[np.arange(30), (np.arange(30) + 1) % 30] = 500
    table = complete(learned(counts, passes=20, batch=256))
    assert (table.argmax(1) == (np.arange(30) + 1) % 30).mean() > 0.9


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    sizes = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda texts, words, order, counts, *rest: sizes.append((len(counts), int(counts.sum()))) or train(texts, words, order, counts, *rest))
    for n in (40, 4_000):
        df = spark.range(n).selectExpr("id * 5 AS doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', pmod(xxhash64(id, i), 37) * pmod(xxhash64(i, id), 41)))) AS text")
        assert lm_scoring.report(df, spread=4).count() == n
    assert sizes[1][0] > 3 * sizes[0][0] and all(size <= 4 * math.sqrt(n) + 2 for size, n in sizes)


def test_scores_equal_the_model(spark, monkeypatch):
    models = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda texts, words, order, counts, *rest: models.append((words, order, counts, train(texts, words, order, counts, *rest))) or models[-1][3])
    rows = corpus(40)
    got = {r.doc_id: r.score for r in lm_scoring.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spread=4).collect()}
    words, order, counts, model = models[0]
    table = complete(model)
    known = Counter(t for i, text in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for t in tokens(text))
    least = math.ceil(math.sqrt(sum(known.values())) / 4)
    rare = {t: c for t, c in known.items() if c < least and t is not None}
    assert counts[0] == sum(rare.values()) and len(counts) == len(known) - len(rare) + 1
    ids = dict(zip(words.tolist(), order.tolist()))
    for i, text in rows:
        hashes, at = lm_scoring.tokens(pa.array([text]))
        mine = [ids.get(h, 0) for h in hashes.tolist()]
        want = sum(table[a, b] for a, b in zip([1, *mine], mine))
        want += sum(math.log10((known[t] + 0.5) / (counts[0] + 0.5 * (len(rare) + 1))) for t, b in zip(tokens(text), mine) if b == 0)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


def test_degenerate_tables(spark):
    schema = "doc_id long, text string"
    assert lm_scoring.report(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = lm_scoring.report(spark.createDataFrame([(held, "only held out")], schema)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 4, 0, 0) and math.isfinite(row.score)
    (row,) = lm_scoring.report(spark.createDataFrame([(held + 1, None)], schema)).collect()
    assert row.n_tokens == 1 and math.isfinite(row.score)
