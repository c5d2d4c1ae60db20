r"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text becomes a sparse vector: its distinct words, hashed into ``BUCKETS`` columns with
weights that rise with the log of their count and have unit norm together, and dense
statistics of its characters, words and lines, and its length. The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

which is linear in the entries of the vector. The machine is fitted by AdaGrad on at most
``SAMPLE`` labelled rows, those with the smallest hashes of their ids; only their vectors
reach the driver. Whole texts are read, and the rest of the table never affects a score.

Null and empty texts get the score of the vector without words. Labels that are null are
not used, several labels of one id are all used. A table without usable labels, or with one
label only, gives the smoothed share of label 1 to every row. Rows are scored one by one:
repeated rows agree, an empty table gives none. Only ``doc_id`` and ``text`` are read, and
from the labels ``doc_id`` and ``quality``; label, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import common

BUCKETS = 1 << 16
RANK = 8
SAMPLE = 6_000
THRESHOLD = 0.3
STATISTICS = 18
_VECTOR = "doc_id long, columns binary, weights binary, y double"


def statistics(data: np.ndarray, offsets: np.ndarray, word_offsets: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Dense columns of each row: shares of kinds of characters, word, line and length figures."""
    sizes = np.diff(offsets)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    chars = np.maximum(count((data & 0xC0) != 0x80), 1)
    n_words = np.diff(word_offsets)
    per_word = np.maximum(n_words, 1)
    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    mark = np.isin(data, np.frombuffer(b"!?", np.uint8))
    symbol = np.isin(data, np.frombuffer(b"#$%&*+<=>@^~\\{}[]", np.uint8))
    bar = data == 124
    newline = data == 10
    lines = count(newline) + 1
    repeated = np.array([repeated_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    columns = [
        np.log1p(sizes) / 10, np.log1p(n_words) / 10, count(upper) / chars, count(lower) / chars, count(digit) / chars, count(data >= 128) / chars,
        np.minimum(count(mark) / per_word, 3), np.minimum(count(symbol) / per_word, 3), np.minimum(count(bar) / per_word, 3),
        np.minimum(count(data == 46) / per_word, 3), np.minimum(count(data == 44) / per_word, 3), np.minimum(chars / per_word, 50) / 10,
        distinct / per_word, np.minimum(per_word / lines, 200) / 50, repeated, np.minimum(count(data == 32) / chars, 1), (n_words == 0).astype(float), np.minimum(per_word, 50) / 50,
    ]
    return np.column_stack(columns) if len(sizes) else np.zeros((0, STATISTICS))


def repeated_lines(data: bytes) -> float:
    """Share of the bytes that stand in lines seen before in the same text."""
    if b"\n" not in data:
        return 0.0
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            again += len(line)
        seen.add(line)
    return again / len(data)


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, weights, row offsets) of a text column; the statistics come after the word columns."""
    data, offsets = common.flat(column)
    hashes, at = common.words(data, offsets, common.byte_classes("space"))
    columns, weights, lengths, distinct = [], [], [], np.zeros(len(offsets) - 1)
    buckets = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    for r in range(len(offsets) - 1):
        own, counts = np.unique(buckets[at[r] : at[r + 1]], return_counts=True)
        w = 1 + np.log(counts)
        distinct[r] = len(own)
        columns.append(own)
        weights.append(w / np.sqrt((w * w).sum()) if len(w) else w)
        lengths.append(len(own))
    dense = statistics(data, offsets, at, distinct)
    for r in range(len(lengths)):
        columns[r] = np.concatenate([columns[r], BUCKETS + np.arange(STATISTICS)])
        weights[r] = np.concatenate([weights[r], dense[r]])
    bounds = np.cumsum([0, *(n + STATISTICS for n in lengths)])
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return joined(columns, np.int64), joined(weights, np.float64), bounds


def raw_score(model: dict, columns: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The machine's sum for each row; every row has at least its statistics, so no row is empty."""
    if len(bounds) == 1:
        return np.zeros(0)
    linear = np.add.reduceat(model["w"][columns] * weights, bounds[:-1])
    part = model["v"][columns] * weights[:, None]
    sums = np.add.reduceat(part, bounds[:-1], axis=0)
    squares = np.add.reduceat(part * part, bounds[:-1], axis=0)
    return model["w0"] + linear + 0.5 * (sums**2 - squares).sum(1)


def fit(columns: np.ndarray, weights: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, l2: float = 1e-5) -> dict:
    """AdaGrad on the logistic loss, in an order fixed by a seed."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = {"w0": float(np.log(share / (1 - share))), "w": np.zeros(BUCKETS + STATISTICS), "v": np.zeros((BUCKETS + STATISTICS, RANK))}
    if len(y) == 0 or y.min() == y.max():
        return model
    draw = np.random.default_rng(7)
    model["v"] = draw.normal(0, 0.05, model["v"].shape)
    seen_w, seen_v, seen_0 = np.full(BUCKETS + STATISTICS, 1e-6), np.full((BUCKETS + STATISTICS, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k : k + batch]
            row, place = common.runs(bounds[rows + 1] - bounds[rows])
            at = bounds[rows][row] + place
            c, x = columns[at], weights[at]
            own = np.concatenate([[0], np.cumsum(bounds[rows + 1] - bounds[rows])])
            error = (1 / (1 + np.exp(-raw_score(model, c, x, own))) - y[rows]) / len(rows)
            part = model["v"][c] * x[:, None]
            sums = np.add.reduceat(part, own[:-1], axis=0)
            slope = (error[row] * x)[:, None] * (sums[row] - part)
            touched, inverse = np.unique(c, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            starts = common.group_bounds(inverse[by])[:-1]
            grad_w = np.add.reduceat((error[row] * x)[by], starts) + l2 * model["w"][touched]
            grad_v = np.add.reduceat(slope[by], starts, axis=0) + l2 * model["v"][touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            seen_0 += error.sum() ** 2
            model["w"][touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            model["v"][touched] -= rate * 0.5 * grad_v / np.sqrt(seen_v[touched])
            model["w0"] -= rate * error.sum() / np.sqrt(seen_0)
    return model


def _to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, 1 << 20):
        columns, weights, bounds = vectors(batch.column(1))
        cut = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), cut(columns, np.int32), cut(weights, np.float32), batch.column(2)], names=["doc_id", "columns", "weights", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on the labelled rows outside fold 0, at most ``sample`` of them."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0))
    chosen = usable.where(common.fold(F.col("id"), 5) != 0).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # at most ``sample`` rows of two numbers: small enough to broadcast at any scale
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    got = rows.mapInArrow(_to_vectors, _VECTOR).orderBy("doc_id", "y").limit(2 * sample).collect()
    columns = [np.frombuffer(r["columns"], np.int32) for r in got]
    bounds = np.cumsum([0, *map(len, columns)])
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return fit(joined(columns, np.int64), joined([np.frombuffer(r["weights"], np.float32) for r in got], np.float64), bounds, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    small = {k: np.asarray(v, np.float32) if k != "w0" else v for k, v in model.items()}
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.slices(batches, 1, 1 << 20):
            p = 1 / (1 + np.exp(-np.clip(raw_score(model, *vectors(batch.column(1))), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p.astype(np.float64), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    small = {k: np.asarray(v, np.float32) if k != "w0" else v for k, v in model.items()}
    shared = docs.sparkSession.sparkContext.broadcast(small)
    cut = float(np.log(threshold / (1 - threshold)))
    state = docs.select(common.whole_row(docs.columns))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.slices(batches, common.row_text, 1 << 20):
            good = raw_score(model, *vectors(common.row_text(batch))) >= cut
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(good, pa.bool_()))

    return state.mapInArrow(kept, common.schema_of(state, "row")).select("row.*")
