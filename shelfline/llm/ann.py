r"""Approximate nearest neighbours by learned partitions of a neighbour graph.

1. On a bounded sample (``SAMPLE`` rows with the smallest hashes of their ids) the graph of
   nearest neighbours is split into balanced parts: vertices move to the part where most
   of their neighbours are, none taking more than its share.
2. A small softmax classifier learns to tell a vector's part, so that it can place any vector.
   Held-out sample rows, which neither parts nor classifier were fitted on, searched in the sample by
   brute force, tell how many of a query's most probable parts must be probed for the share of true neighbours wanted.
3. A part that gets more than ``SPLIT_ROWS`` rows is split again in the same way, from a bounded sample
   of its own rows and in a task of its own, with the held-out rows that probe it as further test queries. So
   the number of parts grows with the table, up to ``LEVELS`` levels; with d levels each aims at the d-th root of ``RECALL``.
4. Every row is placed in its most probable part. A query goes to its most probable parts, at least
   so many that they hold enough rows, and inside them likewise. Parts are cut into blocks by hash, so a part (or a
   third of all rows in one) is never one task, and so are the queries that probe a part; for each pair of blocks products of matrices in double
   precision give the best rows for each query, and a window merges the blocks' lists.

The classifiers are what is broadcast: at most 32 ** ``LEVELS`` parts, that is 1,057 classifiers of 32 parts each.
Nearness is the inner product in double precision, ties go to the smaller ``vec_id``, and a query
never finds its own row. Vectors that are null, zero, of another length than most, or
that hold nulls or numbers that are not finite take no part, neither do null ids. An id on
several rows is one query and one candidate, each pair at its largest product. With fewer candidates than asked for, all are returned.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm import common

SAMPLE = 8_192
HELD_OUT = 512
NEIGHBOURS = 10
PART_ROWS = 256  # sample rows in a part
RECALL = 0.97  # aimed at on held-out rows
BLOCK_ROWS = 4_096
QUERY_ROWS = 16_384  # queries in a block
SPLIT_ROWS = 65_536  # rows from which on a part is split again
LEVELS = 3


# --- learning on the sample ------------------------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS, rows: int = 1024) -> np.ndarray:
    """The ``k`` nearest other rows of each row, by inner product, a block of rows at a time."""
    out = np.empty((len(x), min(k, max(len(x) - 1, 0))), np.int64)
    for a in range(0, len(x), rows):
        s = x[a : a + rows] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if out.shape[1]:
            out[a : a + rows] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vertex: neighbours vote, and no part takes more than its share plus a tenth.

    Starts from balanced nearest seeds. In each round every vertex weighs parts by its
    neighbours in them, and the surest vertices are placed first.
    """
    n = len(x)
    if parts < 2:
        return np.zeros(n, np.int64)
    limit = int(np.ceil(1.1 * n / parts))
    draw = np.random.default_rng(11)
    links = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    own = _place(x @ x[draw.choice(n, parts, replace=False)].T, limit)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (links[:, 0], own[links[:, 1]]), 1.0)
        centres = np.zeros((parts, x.shape[1]))
        np.add.at(centres, own, x)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = _place(votes + x @ centres.T, limit)
    return own


def _place(gain: np.ndarray, limit: int) -> np.ndarray:
    """Each row to its best part that has room, rows with the clearest choice first."""
    n, parts = gain.shape
    wish = np.argsort(-gain, axis=1, kind="stable")
    top = np.take_along_axis(gain, wish[:, :2], 1)
    order = np.argsort(-(top[:, 0] - top[:, 1]), kind="stable")
    room, own = np.full(parts, limit), np.empty(n, np.int64)
    for i in order:
        for p in wish[i]:
            if room[p]:
                room[p] -= 1
                own[i] = p
                break
    return own


def fit_router(x: np.ndarray, own: np.ndarray, parts: int, epochs: int = 60, rate: float = 0.5, batch: int = 256) -> dict:
    """Softmax regression with momentum on unit vectors."""
    draw = np.random.default_rng(5)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for e in range(epochs):
        order = draw.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k : k + batch]
            p = x[rows] @ w + b
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), own[rows]] -= 1
            step = rate * (1 - e / epochs)
            vw = 0.9 * vw - step * (x[rows].T @ p / len(rows) + 1e-5 * w)
            vb = 0.9 * vb - step * p.mean(0)
            w += vw
            b += vb
    return {"w": w, "b": b}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def ranked(router: dict, x: np.ndarray) -> np.ndarray:
    """Parts of each vector, the most probable first."""
    return np.argsort(-(unit(x) @ router["w"] + router["b"]), axis=1, kind="stable")


def held_out(n: int) -> np.ndarray:
    """Of ``n`` sample rows those that only set the number of probes; a quarter at most."""
    return np.arange(0, n, max(4, n // HELD_OUT))


def learn(sample: np.ndarray, neighbours: int, visitors: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """(router, share of true neighbours reached by so many probes) from sampled vectors.

    ``visitors`` are further queries that are not in the sample.
    """
    parts = max(1, len(sample) // PART_ROWS)
    queries = held_out(len(sample))
    x = unit(np.delete(sample, queries, axis=0)) if parts > 1 else unit(sample)
    router = fit_router(x, balanced_parts(x, neighbour_graph(x), parts), parts) if parts > 1 else {"w": np.zeros((x.shape[1], 1)), "b": np.zeros(1)}
    if parts == 1:
        return router, np.ones(1)
    asked = sample[queries] if visitors is None else np.concatenate([sample[queries], visitors])
    where = ranked(router, sample)[:, 0]
    s = asked @ sample.T
    s[np.arange(len(queries)), queries] = -np.inf
    near = np.argpartition(-s, neighbours - 1, axis=1)[:, :neighbours]
    position = np.argsort(ranked(router, asked), axis=1)  # rank of each part for each query
    needed = np.take_along_axis(position, where[near], 1)
    return router, np.array([(needed <= p).mean() for p in range(parts)])


# --- the tree of parts: a list of routers, of which each part leads to a leaf (-1 - its number) or to a further router -------------


def node(router: dict, reached: np.ndarray, level: int, leaves: np.ndarray) -> dict:
    return {**router, "reached": reached, "level": level, "next": -1 - leaves}


def leaf_count(tree: list[dict]) -> int:
    return sum(int((n["next"] < 0).sum()) for n in tree)


def split(tree: list[dict], leaf: int, router: dict, reached: np.ndarray) -> None:
    """Puts a router in place of a leaf; its first part keeps the leaf's number, the others get new ones."""
    parent = next(n for n in tree if (n["next"] == -1 - leaf).any())
    total = leaf_count(tree)
    parent["next"][parent["next"] == -1 - leaf] = len(tree)
    tree.append(node(router, reached, parent["level"] + 1, np.concatenate([[leaf], np.arange(total, total + len(router["b"]) - 1)])))


def leaves_of(tree: list[dict], x: np.ndarray) -> np.ndarray:
    """The leaf where each vector is placed."""
    at = np.zeros(len(x), np.int64)
    while len(inner := np.unique(at[at >= 0])):
        for k in inner:
            own = np.flatnonzero(at == k)
            at[own] = tree[k]["next"][ranked(tree[k], x[own])[:, 0]]
    return -1 - at


def rows_under(tree: list[dict], sizes: np.ndarray) -> list[np.ndarray]:
    """For each router the rows that its parts hold."""
    under: list[np.ndarray] = [np.zeros(0)] * len(tree)
    for k in reversed(range(len(tree))):  # a router stands after the one that leads to it
        under[k] = np.array([sizes[-1 - n] if n < 0 else under[n].sum() for n in tree[k]["next"]])
    return under


def probes_of(tree: list[dict], recall: float = RECALL) -> list[int]:
    """Parts to probe in each router, so that all levels together reach ``recall`` of the true neighbours."""
    target = recall ** (1 / (1 + max(n["level"] for n in tree)))
    return [int(np.argmax(n["reached"] >= target)) + 1 for n in tree]


def route(tree: list[dict], probes: list[int], under: list[np.ndarray], wanted: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``x``, leaf) of all leaves that each vector probes."""
    rows_out, leaves_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        places = ranked(tree[k], x[rows])
        held = np.cumsum(under[k][places], axis=1)
        enough = (held < wanted).sum(1) + 1  # more parts where the likely ones are nearly empty
        query, rank = common.runs(np.minimum(np.maximum(enough, probes[k]), places.shape[1]))
        to = tree[k]["next"][places[query, rank]]
        rows_out.append(rows[query[to < 0]])
        leaves_out.append(-1 - to[to < 0])
        todo += [(int(n), rows[query[to == n]]) for n in np.unique(to[to >= 0])]
    return np.concatenate(rows_out), np.concatenate(leaves_out)


# --- the index and the search ------------------------------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.col("v")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)
    common_size = rows.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size(v) == (common_size["size"] if common_size else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place_rows(shared) -> object:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            part = leaves_of(tree, _matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["vec_id", "v", "part"])

    return place


def _route(shared) -> object:
    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, probes, under, wanted = shared.value
        for batch in batches:
            if batch.num_rows:
                query, leaf = route(tree, probes, under, wanted, _matrix(batch.column(1)))
                take = pa.array(query)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaf, pa.int32())], names=["query_id", "q", "part"])

    return to_parts


def _fit(shared, neighbours: int) -> object:
    def fit(key: tuple, table: pa.Table) -> pa.Table:
        """Of one part: a router from its sampled rows."""
        visitors, leaves = shared.value
        table = table.sort_by("r")
        x = _matrix(table["v"])
        router, reached = learn(x, min(neighbours, len(x) - 1), visitors[leaves == key[0].as_py()])
        blob = pickle.dumps((router, reached))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    return fit


def _search(k: int) -> object:
    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        """Of one block: the ``k`` nearest rows for each query that probes it."""
        ids, x = common.ints(rows["vec_id"], 0), _matrix(rows["v"])
        asked, q = common.ints(queries["query_id"], 0), _matrix(queries["q"])
        twice = len(np.unique(ids)) < len(ids)  # an id on several rows is one candidate, so none is left out before
        out = []
        for a in range(0, len(asked) if len(ids) else 0, 256):
            part, own = q[a : a + 256], asked[a : a + 256]
            rough = part @ x.T
            rough[ids[None, :] == own[:, None]] = -np.inf
            if len(ids) > k and not twice:  # all that can be among the first k, ties and rounding included
                edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
                near = rough >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
            else:
                near = np.ones(rough.shape, bool)
            near &= rough > -np.inf
            i, j = np.nonzero(near)
            exact = np.einsum("ij,ij->i", part[i], x[j])
            if twice:
                order = np.lexsort((-exact, ids[j], i))
                i, j, exact = i[order], j[order], exact[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (ids[j][1:] != ids[j][:-1])
                i, j, exact = i[new], j[new], exact[new]
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            start = np.searchsorted(i, i, "left")
            best = np.arange(len(i)) - start < k
            out.append((own[i[best]], ids[j[best]], exact[best]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return search


def _counts(placed: DataFrame, parts: int) -> np.ndarray:
    """Rows of each part; one row per part comes to the driver."""
    out = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect():
        out[r.part] = r.n
    return out


def index(rows: DataFrame, k: int, sample: int = SAMPLE, split_rows: int = SPLIT_ROWS) -> tuple[list[dict], DataFrame, np.ndarray]:
    """(tree of routers, rows with their part, rows of each part)."""
    context = rows.sparkSession.sparkContext
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    chosen = rows.orderBy(*order).limit(sample).collect()
    x = np.array([r.v for r in chosen], np.float64) if chosen else np.zeros((0, 1))
    router, reached = learn(x, min(k, max(len(chosen) - 1, 1))) if len(chosen) else ({"w": np.zeros((1, 1)), "b": np.zeros(1)}, np.ones(1))
    tree = [node(router, reached, 0, np.arange(len(router["b"])))]
    visitors = x[held_out(len(x))] if len(x) else x
    while True:
        placed = rows.mapInArrow(_place_rows(context.broadcast(tree)), "vec_id long, v array<double>, part int")
        sizes = _counts(placed, leaf_count(tree))
        level = {-1 - int(n): t["level"] for t in tree for n in t["next"] if n < 0}
        large = [p for p, n in enumerate(sizes) if n > split_rows and level[p] + 1 < LEVELS]
        if not large:
            return tree, placed, sizes
        query, leaves = route(tree, probes_of(tree), rows_under(tree, sizes), k + 1, visitors)
        drawn = placed.where(F.col("part").isin(large)).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("r") <= sample)
        fits = drawn.groupBy("part").applyInArrow(_fit(context.broadcast((visitors[query], leaves)), k), "part int, blob binary")
        fitted = [(r.part, *pickle.loads(r.blob)) for r in fits.orderBy("part").collect()]  # a router for each part that is split
        for part, router, reached in fitted:
            if len(router["b"]) > 1:
                split(tree, part, router, reached)
        if all(len(router["b"]) == 1 for _, router, _ in fitted):
            return tree, placed, sizes


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, query_rows: int = QUERY_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for every row that ``is_query`` (of vec_id) picks."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    tree, placed, sizes = index(rows, k, sample, split_rows)
    shared = spark.sparkContext.broadcast((tree, probes_of(tree), rows_under(tree, sizes), k + 1))
    asked = rows.where(is_query).mapInArrow(_route(shared), "query_id long, q array<double>, part int")

    probing = _counts(asked, len(sizes))
    blocks = [(p, int(max(1, -(-n // BLOCK_ROWS))), int(max(1, -(-m // query_rows)))) for p, (n, m) in enumerate(zip(sizes, probing, strict=True))]
    cut = F.broadcast(spark.createDataFrame(blocks, "part int, of_rows int, of_queries int"))  # one row per part, 32 ** LEVELS at most
    placed, asked = placed.join(cut, "part"), asked.join(cut, "part")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("of_rows")).cast("int")).withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("of_queries") - 1)))
    asked = asked.withColumn("asking", F.pmod(F.xxhash64("query_id", "q"), F.col("of_queries")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of_rows") - 1)))
    pair = ["part", "block", "asking"]
    placed, asked = placed.select(*pair, "vec_id", "v"), asked.select(*pair, "query_id", "q")
    found = placed.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(embeddings: DataFrame, step: int, k: int = 20) -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``step``."""
    return nearest(embeddings, F.col("vec_id") % step == 0, k)
