r"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased, then one end. Every training
token that occurs at least sqrt(N) / ``SPREAD`` times, N being all training tokens, has a vector: at most
SPREAD sqrt(N) of them, so the vocabulary grows with the corpus, the model stays small beside it, and the
cost of normalising, which is the square of the vocabulary, grows like the corpus. All other tokens
are one class, ``rare``. With word vectors R, a context matrix C and biases b, the model is

    s(w | h) = log Pn(w) + b_w + (R_h C) . R_w,     P(w | h) = exp s(w | h) / sum_v exp s(v | h),

h being the token before (the end, at the start of a text). A rare token has P(rare | h) times its
smoothed share among rare training tokens, (c + 0.5) / (N_rare + 0.5 (V_rare + 1)).

Training minimises the NCE objective over all pairs (h, w) of all training texts, ``NOISE`` noise tokens, drawn from the
unigram distribution Pn, standing against each real one. Each task learns from the texts of its partitions as they
pass: it counts the pairs of a slice of text, goes through them in small batches, a frequent pair in many of them by equal parts, that share their draws, by products of matrices, and keeps
the model only. Tasks hand on the rows of the model that they touched, weighted by the tokens that
touched them; blocks of rows are averaged in a shuffle, and the next of ``ROUNDS`` passes starts from there. There are no more tasks than let their
models together stay below a quarter of the corpus. The sums over v are batched products too, a block of contexts per
task. A partition that is computed again gives the same rows; other partitions give a slightly different model.

Exact token counts, needed for every token of every text, never meet in one place either: texts are
grouped in chunks by hash, a chunk sends its distinct tokens with their counts to buckets by token hash, and each
bucket answers every chunk with the totals of the tokens it asked for. A frequent token is one
entry per chunk. Tokens are known by 64-bit hashes. The driver gets the vocabulary and the model, whose size is bounded as said.

``base_score`` is the unigram score: sum of log10((c + 0.5) / (N + 0.5 (V + 1))), c, N and V being
counts in training. A null or empty text is one end. Training rows are those for which
crc32(doc_id as text) mod 5 is not 1; a null id counts as the empty text. Equal rows are scored alike
and count in training each. Without training rows N = V = 0 and all tokens are equally unlikely. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import common
from shelfline.session import stash

SPREAD = 16
RANK = 32
NOISE = 10
ROUNDS = 2
BATCH = 2_048  # distinct pairs
SHARE = 8  # tokens of one pair in a batch, at most
DRAWS = 128  # noise tokens that a batch shares
RATE = 0.05  # of the first pass, divided by the number of the pass
_ROWS = 1_024  # of the model, in one block
END = np.uint64(1)  # stands for the end among token hashes
_CHUNK_BYTES = 24 << 20
_SLICE = 4 << 20  # bytes of a chunk whose tokens are held at once
_MESSAGE = "bucket int, chunk int, kind string, blob binary, n long, v long"


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row offsets), every row closed by its end."""
    hashes, at = common.words(*common.flat(column), common.byte_classes("space"))
    rows = len(at) - 1
    return np.insert(hashes, at[1:], END) if rows else hashes, at + np.arange(rows + 1)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "kind", "blob", "n", "v"])


def _pieces(texts: pa.Table) -> Iterator[pa.RecordBatch]:
    return common.slices(texts.to_batches(), lambda batch: batch.column("text"), _SLICE)


def _ask(buckets: int) -> object:
    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        """Of one chunk: its distinct tokens and their training counts, by bucket."""
        found, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in _pieces(texts):
            hashes, at = tokens(piece.column("text"))
            training = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            own, place = np.unique(hashes, return_inverse=True)
            found.append(own)
            seen.append(np.bincount(place[np.repeat(training, np.diff(at))], minlength=len(own)))
        distinct, place = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, place, np.concatenate(seen))
        bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        bounds = common.group_bounds(bucket)
        return _messages([(int(bucket[i]), key[0].as_py(), "ask", common.pack(np.diff(distinct[i:j], prepend=np.uint64(0)), counts[i:j].astype(np.uint32)), None, None) for i, j in zip(bounds[:-1], bounds[1:], strict=True) if j > i])

    return ask


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Of one bucket: total counts for every chunk, the sums, and its training tokens."""
    chunks = asked["chunk"].to_pylist()
    parts = [common.unpack(b.as_py()) for b in asked["blob"]]
    own = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    distinct, place = np.unique(np.concatenate(own), return_inverse=True)
    totals = np.bincount(place, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
    rows, at = [], 0
    for chunk, mine in zip(chunks, own, strict=True):
        rows.append((None, chunk, "count", common.pack(np.diff(mine, prepend=np.uint64(0)), totals[place[at : at + len(mine)]]), None, None))
        at += len(mine)
    rows.append((key[0].as_py(), None, "own", common.pack(distinct[totals > 0], totals[totals > 0]), int(totals.sum()), int((totals > 0).sum())))
    return _messages(rows)


def _frequent(least: int) -> object:
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of buckets that occur ``least`` times, and always the end."""
        for batch in batches:
            for blob in batch.column(0):
                tokens, counts = common.unpack(blob.as_py())
                keep = (counts >= least) | (tokens == END)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64), pa.int64()), pa.array(counts[keep], pa.int64())], names=["token", "n"])

    return frequent


# --- the model ---------------------------------------------------------------------------------------------------------------


def to_ids(hashes: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Vocabulary ids of token hashes; ``words`` are sorted and ``order`` gives their ids."""
    place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[place] == hashes, order[place], 0)


def _before(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each one, which is the end at the start of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = 1
    return before


def start(counts: np.ndarray, rank: int = RANK) -> dict[str, np.ndarray]:
    """An untrained model: the unigram distribution of ``counts``, and small random vectors."""
    draw = np.random.default_rng(3)
    size = len(counts)
    model = {"R": draw.normal(0, 0.1, (size, rank)), "C": np.eye(rank) + draw.normal(0, 0.01, (rank, rank)), "b": np.zeros(size)}
    smoothed = (counts + 0.5) / (counts.sum() + 0.5 * size)
    return {k: v.astype(np.float32) for k, v in (model | {"log_noise": np.log(smoothed)}).items()}


class Learner:
    """A model in training: pairs come in, gradients of the NCE objective move the rows they touch (Adagrad)."""

    def __init__(self, model: dict[str, np.ndarray], noise: float = NOISE, batch: int = BATCH, draws: int = DRAWS, rate: float = RATE):
        self.R, self.C, self.b = (model[k].copy() for k in ("R", "C", "b"))
        self.noise, self.batch, self.draws, self.rate = noise, batch, draws, rate
        self.bounds = np.cumsum(np.exp(model["log_noise"].astype(np.float64)))
        self.seen = np.zeros(len(self.b), np.float64)  # tokens that touched a row
        self.vectors, self.biases, self.matrix = (np.full(n, 1e-8, np.float32) for n in (len(self.b), len(self.b), 1))

    def learn(self, context: np.ndarray, token: np.ndarray, n: np.ndarray) -> None:
        """Go once through distinct pairs with their counts, in an order and with noise that they determine."""
        random = np.random.default_rng([len(n), int(n.sum()), int(token[:64].sum())])
        self.seen += np.bincount(token, n, len(self.seen)) + np.bincount(context, n, len(self.seen))
        parts = -(-n // SHARE)  # a frequent pair comes in many batches, by equal parts
        context, token, n = (np.repeat(x, parts) for x in (context, token, n / parts))
        order = random.permutation(len(n))
        for at in range(0, len(n), self.batch):
            own = order[at : at + self.batch]
            noise = np.minimum(np.searchsorted(self.bounds, (np.arange(self.draws) + random.random(self.draws)) / self.draws * self.bounds[-1]), len(self.b) - 1)
            self._step(context[own], token[own], n[own].astype(np.float32), noise)

    def _step(self, h: np.ndarray, w: np.ndarray, n: np.ndarray, z: np.ndarray) -> None:
        odd = lambda x: 1 / (1 + np.exp(np.clip(np.float32(np.log(self.noise)) - x, -30, 30)))
        of_h, of_w, of_z = self.R[h], self.R[w], self.R[z]
        context = of_h @ self.C
        # s - log(noise * Pn) has no log Pn left
        real = n * (1 - odd((context * of_w).sum(1) + self.b[w]))
        drawn = -(n * np.float32(self.noise / len(z)))[:, None] * odd(context @ of_z.T + self.b[z])
        by_context = real[:, None] * of_w + drawn @ of_z
        self._move(self.R, self.vectors, np.concatenate([h, w, z]), np.concatenate([by_context @ self.C.T, real[:, None] * context, drawn.T @ context]))
        self._move(self.b[:, None], self.biases, np.concatenate([w, z]), np.concatenate([real, drawn.sum(0)])[:, None])
        slope = of_h.T @ by_context
        self.matrix += (slope * slope).mean()
        self.C += np.float32(self.rate) * slope / np.sqrt(self.matrix)

    def _move(self, rows: np.ndarray, squares: np.ndarray, which: np.ndarray, slopes: np.ndarray) -> None:
        order = np.argsort(which, kind="stable")
        bounds = common.group_bounds(which[order])[:-1]
        touched = which[order][bounds]
        slope = np.add.reduceat(slopes[order], bounds, axis=0)
        squares[touched] += (slope * slope).mean(1)
        rows[touched] += np.float32(self.rate) * slope / np.sqrt(squares[touched])[:, None]


def _learn(shared, rate: float) -> object:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the model that a partition touched, by blocks; block -1 is the context matrix."""
        words, order, model = shared.value
        size = len(model["b"])
        learner = Learner(model, rate=rate)
        for batch in common.slices(batches, 0, 8 << 20):
            hashes, at = tokens(batch.column(0))
            ids = to_ids(hashes, words, order)
            codes, n = np.unique(_before(ids, at) * size + ids, return_counts=True)
            learner.learn(codes // size, codes % size, n)
        out = [(-1, common.pack(learner.C.ravel(), learner.seen.sum(keepdims=True)))] if learner.seen.any() else []
        for block in np.unique(np.flatnonzero(learner.seen) // _ROWS):
            rows = block * _ROWS + np.flatnonzero(learner.seen[block * _ROWS : (block + 1) * _ROWS])
            out.append((int(block), common.pack(rows, learner.R[rows].ravel(), learner.b[rows], learner.seen[rows])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "blob"])

    return learn


def _mean(rank: int) -> object:
    def mean(key: tuple, learned: pa.Table) -> pa.Table:
        """Of one block: the mean of what the tasks learned, by the tokens they learned from."""
        block = key[0].as_py()
        first, weight, order = 0, 0.0, []
        parts = [common.unpack(b.as_py()) for b in learned["blob"]]
        if block < 0:
            parts.sort(key=lambda p: p[0].tobytes())  # sums do not depend on the order of arrival
            weight = sum(p[1][0] for p in parts)
            blob = common.pack((sum(p[0].astype(np.float64) * p[1][0] for p in parts) / weight).astype(np.float32))
        else:
            parts.sort(key=lambda p: (p[3].tobytes(), p[1].tobytes()))
            first = block * _ROWS
            sums, biases, weight = np.zeros((_ROWS, rank)), np.zeros(_ROWS), np.zeros(_ROWS)
            for rows, vectors, bias, seen in parts:
                sums[rows - first] += vectors.reshape(-1, rank) * seen[:, None]
                biases[rows - first] += bias * seen
                weight[rows - first] += seen
            order = np.flatnonzero(weight)
            blob = common.pack(order + first, (sums[order] / weight[order, None]).astype(np.float32).ravel(), (biases[order] / weight[order]).astype(np.float32))
        return pa.Table.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])

    return mean


def train(texts: DataFrame, words: np.ndarray, order: np.ndarray, counts: np.ndarray, n_bytes: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The model of the vocabulary ``words`` with ids ``order`` and ``counts`` by id, learned from ``texts``."""
    context, model = texts.sparkSession.sparkContext, start(counts)
    tasks = max(1, n_bytes // (4 * 4 * (RANK + 4) * len(counts)))
    for k in range(rounds):
        shared = context.broadcast((words, order, model))
        learned = texts.coalesce(tasks).mapInArrow(_learn(shared, RATE / (k + 1)), "block int, blob binary")
        model = {k: v.copy() for k, v in model.items()}
        for row in learned.groupBy("block").applyInArrow(_mean(RANK), "block int, blob binary").toLocalIterator():
            parts = common.unpack(bytes(row.blob))
            if row.block < 0:
                model["C"] = parts[0].reshape(RANK, RANK)
            else:
                model["R"][parts[0]], model["b"][parts[0]] = parts[1].reshape(-1, RANK), parts[2]
    return model


def log_sums(model: dict[str, np.ndarray], first: int, last: int, rows: int = 256, columns: int = 1 << 14) -> np.ndarray:
    """log of the sum over all tokens of exp s, for the contexts from ``first`` to before ``last``, a tile of contexts and tokens at a time."""
    context = model["R"][first:last] @ model["C"]
    out = np.empty(len(context))
    for a in range(0, len(context), rows):
        most, total = np.full(len(context[a : a + rows]), -np.inf, context.dtype), 0.0
        for t in range(0, len(model["b"]), columns):
            own = slice(t, t + columns)
            s = context[a : a + rows] @ model["R"][own].T + (model["b"][own] + model["log_noise"][own])
            before, most = most, np.maximum(most, s.max(1))
            s -= most[:, None]
            total = total * np.exp(before - most, dtype=np.float64) + np.exp(s, out=s).sum(1, dtype=np.float64)
        out[a : a + rows] = np.log(total) + most
    return out


def _normalise(shared) -> object:
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                sums = log_sums(model, block * _ROWS, min((block + 1) * _ROWS, len(model["b"])))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([common.pack(sums)], pa.binary())], names=["id", "blob"])

    return normalise


def log_probabilities(model: dict[str, np.ndarray], context: np.ndarray, token: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """log10 P(token | context) of pairs of ids; ``log_sums`` of the model are at ``log_z``."""
    out = np.empty(len(token))
    for a in range(0, len(token), rows):
        h, w = context[a : a + rows], token[a : a + rows]
        out[a : a + rows] = np.einsum("ij,ij->i", model["ahead"][h], model["R"][w]) + model["b"][w] + model["log_noise"][w] - model["log_z"][h]
    return out / np.log(10)


def _score(shared) -> object:
    def score(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
        """Of one chunk: scores of its texts, a few of them at a time."""
        parts = [common.unpack(b.as_py()) for b in counts["blob"]]
        known = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
        total = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        by = np.argsort(known)
        known, total = known[by], total[by]
        return pa.concat_tables([piece_of(piece, known, total) for piece in _pieces(texts)] or [piece_of(texts.slice(0, 0), known, total)])

    def piece_of(texts: pa.RecordBatch | pa.Table, known: np.ndarray, total: np.ndarray) -> pa.Table:
        words, order, model, n, v, n_rare, v_rare = shared.value
        hashes, at = tokens(texts.column("text"))
        c = total[np.searchsorted(known, hashes)] if len(hashes) else np.zeros(0, np.int64)
        ids = to_ids(hashes, words, order)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        own = log_probabilities(model, _before(ids, at), ids) + np.where(ids == 0, np.log10((c + 0.5) / (n_rare + 0.5 * (v_rare + 1))), 0.0)
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        rows = len(at) - 1
        return pa.Table.from_arrays(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(np.diff(at), pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(rows, n), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(own), pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def report(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """One row per document: token counts, unigram score and model score (log10 of the text's probability).

    Counting, training and normalising run when this is called.
    """
    spark = docs.sparkSession
    n_bytes = common.text_bytes(docs)
    chunks = common.chunk_count(spark, n_bytes, _CHUNK_BYTES)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    # with the text, so that null or repeated ids do not fill one chunk
    chunk = F.pmod(F.xxhash64(F.lit(1), doc_id, text), F.lit(chunks)).cast("int")
    rows = docs.select(chunk.alias("chunk"), doc_id.alias("doc_id"), (common.fold(F.col("doc_id"), 5) == 1).alias("held_out"), text.alias("text"))
    texts = rows.groupBy("chunk")

    asked = texts.applyInArrow(_ask(chunks), _MESSAGE)
    answers = stash(asked.groupBy("bucket").applyInArrow(_answer, _MESSAGE), "lm-counts")
    own = answers.where("kind = 'own'")
    n, v = (x or 0 for x in own.agg(F.sum("n"), F.sum("v")).first())
    least = max(1, math.ceil(math.sqrt(n) / spread))
    found = own.select("blob").mapInArrow(_frequent(least), "token long, n long").toArrow()
    frequent, number = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by = np.argsort(frequent)
    frequent, number = frequent[by], number[by]
    inner = frequent != END
    words = np.concatenate([np.array([END], np.uint64), frequent[inner]])
    counts = np.concatenate([[n - number.sum()], number[~inner] if (~inner).any() else [0], number[inner]]).astype(np.int64)
    by = np.argsort(words)
    words, order = words[by], by + 1
    n_rare, v_rare = int(counts[0]), v - len(frequent)

    model = train(rows.where(~F.col("held_out")).select("text"), words, order, counts, n_bytes)
    shared = spark.sparkContext.broadcast(model)
    blocks = math.ceil(len(counts) / _ROWS)
    sums = spark.range(0, blocks, 1, min(blocks, common.parallelism(spark))).mapInArrow(_normalise(shared), "id long, blob binary")
    log_z = np.concatenate([common.unpack(bytes(r.blob))[0] for r in sorted(sums.collect(), key=lambda r: r.id)])
    shared = spark.sparkContext.broadcast((words, order, model | {"ahead": model["R"] @ model["C"], "log_z": log_z}, n, v, n_rare, v_rare))
    totals = answers.where("kind = 'count'").select("chunk", "blob").groupBy("chunk")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.cogroup(totals).applyInArrow(_score(shared), schema)
