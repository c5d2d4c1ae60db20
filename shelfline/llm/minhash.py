r"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

A document is the weighted set of its five-word shingles (a shorter one is one shingle of
all its words). Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Weights are 1,
for which weighted Jaccard similarity is that of plain sets; ``dart_sketch`` takes any weights.

Sketch. Darts fall on each element as a Poisson process over weight and rank, fixed by a
hash of the element, cell by cell of a dyadic grid. A dart counts if it lands below the
element's weight and below a rank that lets about k log k + 2k darts through, whatever
the number of elements. Every dart belongs to one of k coordinates, whose signature is the
dart of the lowest rank; if one stays empty the rank limit doubles. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.

Joining. Documents with equal shingle sets are one node. Signatures are cut into bands;
nodes that share a band key meet in a star around its leader, the node of the least hash,
never in all pairs. Pairs that length and one-bit sketches allow are checked exactly on
shingle sets and give links, and linked nodes form classes. Band keys that still hold
nodes of several classes get a second look, which loses no link between classes: their
shingle sets are dealt to tasks in pairs of blocks of ``BLOCK_NODES``, and an inverted index there
finds every similar pair of nodes of different classes. Only links that join classes leave a
task, so their number is bounded by that of its nodes.

Result: one row per document with ``class_id``, the smallest id of its class, and
``keep``, true for one row of each class. Null, empty and wordless texts are classes of
their own. A null id is listed after all others; a class of null ids only has a null
``class_id``. Equal rows are one class of which one row is kept. An empty table gives an
empty result. Other columns are never read.

Nodes and shingles are known by 64-bit and, in the exact check, 32-bit hashes. The
one-bit filter (at most ``MAX_BITS`` of 125 bits differ; 12.5 are expected at similarity
0.8) errs with probability below 1e-12, the bands miss a pair of similarity 0.8 with
probability 5e-5 and far less above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm import common
from shelfline.session import stash

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
MAX_BITS = 38
BLOCK_NODES = 1_024
GROUP_NODES = 2_000  # nodes, of as many band keys as it takes, in one task of the second look
_FIRST_RANK = 0.25
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# --- shingles and sketches -------------------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    hashes, at = common.words(*common.flat(column), common.byte_classes("alnum"))
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        rolled = common.mix(rolled + hashes[j : j + max(n, 0)] * _C[j % len(_C)])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for j in range(a, b):
                value = common.mix(value + hashes[j : j + 1] * _C[1])
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _poisson_table(mean: float) -> np.ndarray:
    """Upper ends of the 64-bit ranges that stand for 0, 1, 2, ... darts."""
    top = int(mean + 12 * math.sqrt(mean) + 16)
    logs = -mean + np.arange(top) * math.log(mean) - np.array([math.lgamma(i + 1) for i in range(top)])
    return np.minimum(np.cumsum(np.exp(logs)), 1 - 2**-53)


def dart_sketch(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Signatures (sets x k) of several weighted sets laid end to end; set i has the entries bounds[i]:bounds[i+1].

    Sets without positive weight keep zeros.
    """
    n_sets = len(bounds) - 1
    out = np.zeros((n_sets, k), np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    mass = np.bincount(owner, weights, n_sets)
    expected = k * math.log(k) + 2 * k
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        limit = np.zeros(n_sets)
        limit[todo] = expected / mass[todo]
        rank, code, dart = _throw(elements, weights, owner, limit, k)
        order = np.lexsort((rank, code))
        code, dart = code[order], dart[order]
        first = common.group_bounds(code)[:-1]
        out[code[first] // k, code[first] % k] = dart[first]
        full = np.bincount(code[first] // k, minlength=n_sets)[todo] == k
        todo = todo[~full]
        if len(todo):  # again for sets with an empty coordinate, with twice the darts
            expected *= 2
            member = np.isin(owner, todo)
            elements, weights, owner = elements[member], weights[member], owner[member]
    return out


def _throw(elements, weights, owner, limit, k):
    """(rank, set * k + coordinate, dart) of all darts that count."""
    ranks, codes, darts = [], [], []
    reach = limit[owner]
    w_low, w_high, w_cell = 0.0, 1.0, 0
    while w_low < weights.max(initial=0):
        r_low, r_high, r_cell = 0.0, _FIRST_RANK, 0
        while True:
            pick = np.flatnonzero((weights > w_low) & (reach > r_low))
            if len(pick) == 0:
                break
            cell = common.mix(elements[pick] * _C[0] + np.array([w_cell * 4096 + r_cell + 1], np.uint64) * _C[1])
            counts = np.searchsorted(_poisson_table((w_high - w_low) * (r_high - r_low)), (cell >> np.uint64(11)) * 2.0**-53, "right")
            which, number = common.runs(counts)
            dart = common.mix(cell[which] + (number.astype(np.uint64) + np.uint64(1)) * _C[2])
            w = w_low + (w_high - w_low) * (common.mix(dart ^ _C[3]) >> np.uint64(11)) * 2.0**-53
            r = r_low + (r_high - r_low) * (common.mix(dart ^ _C[4]) >> np.uint64(11)) * 2.0**-53
            entry = pick[which]
            good = (w < weights[entry]) & (r < reach[entry])
            ranks.append(r[good])
            darts.append(dart[good])
            codes.append(owner[entry[good]] * k + ((dart[good] >> np.uint64(20)) % np.uint64(k)).astype(np.int64))
            r_low, r_high, r_cell = r_high, r_high * 2, r_cell + 1
        w_low, w_high, w_cell = w_high, w_high * 2, w_cell + 1
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(ranks, np.float64), join(codes, np.int64), join(darts, np.uint64)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per set and band; keys of different bands differ."""
    keys = np.zeros((len(signatures), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _C[3]
    for j in range(rows):
        keys = common.mix(keys + signatures[:, np.arange(bands) * rows + j] * _C[1])
    return keys


def one_bit(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that hold one bit of each coordinate."""
    bits = (signatures & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), axis=1)
    words = np.ascontiguousarray(packed).view(np.int64)
    return words[:, 0], words[:, 1]


_SIGNED = "doc_id long, th long, node long, n int, s1 long, s2 long, bands binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 2, 1 << 20):
        sets = shingle_sets(batch.column(2))
        bounds = np.cumsum([0, *map(len, sets)])
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        signatures = dart_sketch(elements, np.ones(len(elements)), bounds)
        keys = band_keys(signatures).astype("<u8")
        s1, s2 = one_bit(signatures)
        sizes = np.diff(bounds)
        bare = sizes == 0
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(elements ^ _C[2]), dtype=np.uint64)])
        node = common.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64)
        column = lambda a, kind: pa.array(a, kind, mask=bare)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), column(node, pa.int64()), pa.array(sizes, pa.int32()), column(s1, pa.int64()), column(s2, pa.int64()), pa.array([None if b else row.tobytes() for b, row in zip(bare, keys, strict=True)], pa.binary())],
            names=["doc_id", "th", "node", "n", "s1", "s2", "bands"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        times = np.repeat(np.arange(batch.num_rows), BANDS)
        rest = [batch.column(i).take(pa.array(times)) for i in (0, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *rest], names=["key", "node", "n", "s1", "s2"])


# --- candidate pairs, exact check, classes -------------------------------------------------------------------------------------


def _plausible(a: str, b: str, threshold: float):
    """What every pair of at least ``threshold`` meets: sizes alike, and few different bits."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (bits <= MAX_BITS)


def _similar(threshold: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                (x,), (y,) = common.unpack(x.as_py()), common.unpack(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return similar


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, 1 << 20):
        sets = [common.pack(np.unique(s.astype(np.uint32))) for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_similar(threshold), "a long, b long")


def _second_look(met: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of different classes that share a band key."""
    spark = met.sparkSession
    rows = met.select("key", F.col("own.node").alias("node")).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rows = stash(rows, "minhash-placed")
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks")).where("least != most")
    rows = rows.join(mixed.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select("key", "node", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = stash(dealt, "minhash-dealt")
    tasks = max(common.parallelism(spark), math.ceil(dealt.count() / GROUP_NODES))
    task = F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)).alias("task")
    return dealt.join(sets, "node").select(task, "key", "low", "high", "node", "root", "shingles").groupBy("task").applyInArrow(_joining_links(threshold), "a long, b long")


def _joining_links(threshold: float):
    def joining(key: tuple, rows: pa.Table) -> pa.Table:
        band, low, high, node, root = (common.ints(rows[c], 0) for c in ("key", "low", "high", "node", "root"))
        blobs = rows["shingles"].combine_chunks() if rows.num_rows else []
        order = np.lexsort((node, high, low, band))
        change = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        links = []
        for own in np.split(order, change) if len(order) else []:
            if len(np.unique(root[own])) > 1:
                links += cross_links([common.unpack(blobs[int(i)].as_py())[0] for i in own], node[own], root[own], threshold)
        return pa.Table.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return joining


def cross_links(sets: list[np.ndarray], node: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Similar pairs of nodes that join classes, until no similar pair is left between two classes.

    Only nodes outside the largest class need to look: every such pair has one.
    """
    _, group = np.unique(root, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(term, kind="stable")
    posting = owner[by]
    starts = np.searchsorted(term[by], np.arange(term.max() + 2))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links = []
    for x in np.flatnonzero(group != np.bincount(group).argmax()):
        terms = term[bounds[x] : bounds[x + 1]]
        run, place = common.runs(starts[terms + 1] - starts[terms])
        both = np.bincount(posting[starts[terms][run] + place], minlength=len(sets))
        alike = np.flatnonzero((both >= threshold * (sizes[x] + sizes - both) - 1e-9) & (group != group[x]))
        for y in alike:
            if group[y] != group[x]:
                links.append((int(node[x]), int(node[y])))
                group[group == group[y]] = group[x]
    return links


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for all nodes of the links; the root is the smallest node of the component.

    Each round every node takes the smallest root around it, then the root of its root;
    rounds end when nothing changes. Rounds are written out, so lineage stays short.
    """
    both = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    roots = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{label}-roots")
    while True:
        around = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hung = roots.join(around, "node").select("node", "root", F.least("root", "near").alias("best"))
        above = roots.select(F.col("node").alias("best"), F.col("root").alias("over"))
        following = stash(hung.join(above, "best").select("node", F.col("root").alias("was"), F.least("best", "over").alias("root")), f"{label}-roots")
        changed = not following.where(F.col("was") != F.col("root")).isEmpty()
        roots = following.select("node", "root")
        if not changed:
            return roots


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``class_id`` and ``keep`` of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = stash(source.mapInArrow(_sign, _SIGNED), "minhash-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "th"))
    nodes = stash(
        signed.where(F.col("node").isNotNull()).groupBy("node").agg(least.alias("first"), F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")),
        "minhash-nodes",
    )
    keyed = nodes.select("node", "bands", "n", "s1", "s2").mapInArrow(_keys, "key long, node long, n int, s1 long, s2 long")
    drawn = F.min(F.struct(F.xxhash64("node").alias("draw"), "node", "n", "s1", "s2"))
    leaders = keyed.groupBy("key").agg(F.count("*").alias("members"), drawn.alias("leader")).where("members > 1").select("key", "leader")
    met = stash(keyed.join(leaders, "key").select("key", F.struct("node", "n", "s1", "s2").alias("own"), "leader"), "minhash-met")

    stars = met.where((F.col("own.node") != F.col("leader.node")) & _plausible("own", "leader", threshold))
    stars = stash(stars.select(F.col("own.node").alias("a"), F.col("leader.node").alias("b")).distinct(), "minhash-stars")
    involved = met.select(F.col("own.node").alias("node")).distinct().join(nodes.select("node", "first"), "node")
    texts = source.join(involved, source["doc_id"].eqNullSafe(F.col("first.doc_id")) & (source["th"] == F.col("first.th")))
    sets = stash(texts.select("node", "text").mapInArrow(_to_sets, "node long, shingles binary").dropDuplicates(["node"]), "minhash-sets")
    edges = stash(links(stars, sets, threshold), "minhash-links")
    roots = components(edges, "minhash")

    more = stash(_second_look(met, roots, sets, threshold), "minhash-more-links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more), "minhash-all")

    rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    headed = rooted.join(heads, "root").select("node", "head")
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "th")
    listed = signed.select("doc_id", "th", "node", own.alias("own")).join(headed, "node", "left")
    head = F.coalesce("head", "own")
    return listed.select("doc_id", "th", F.col("node"), head["doc_id"].alias("class_id"), (head == F.col("own")).alias("keep"))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, and ``keep`` for the document that stands for its class."""
    return classes(docs, threshold).select("doc_id", "class_id", "keep")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns."""
    kept = classes(docs, threshold).where("keep").select(F.col("doc_id").alias("id"), "th", "node").distinct()
    rows = docs.select(common.whole_row(docs.columns), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(kept, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    # rows that repeat a kept one stand next to it after the join; one stays, by its content, but wordless ones are no class
    turn = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.xxhash64("row"), F.to_json(F.struct("row"))))
    return joined.withColumn("turn", turn).where((F.col("turn") == 1) | F.col("node").isNull()).select("row.*")
