"""Prefix trie of conversations, with subtree totals by a depth-band rollup.

A conversation is its turns ordered by ``turn`` (null first; equal turns by a hash of role
and text). Null role or text counts as empty. Conversation c is rebuilt as the first
h = crc32(c as text) % ``HEADS`` turns of conversation c - c % ``FAMILY`` (all if it has
fewer, none if it does not exist), then its own turns after its first h.

A node is a distinct sequence of first d rebuilt turns. It is known by d and two 64-bit
polynomial hashes of its turns' hashes; two different sequences of one length share them
with probability 2**-128. Such a hash is a sum, so the turns of one conversation can be
summed in several tasks (rows are range-partitioned by conversation and turn, and the sums
before a partition are added later): a conversation may hold any share of all rows. Texts are hashed
where they are read and are never shuffled.

Depth-band rollup: depths are cut into bands of ``HEIGHT``. Each node, by the path of its
smallest member, adds its values to its ancestors inside its band only, so it becomes at
most ``HEIGHT`` rows. The totals of band roots are again a trie, ``HEIGHT`` times flatter, which is
rolled up the same way; a finished band root then adds its total to its ancestors in the band above.
There are about log(depth, ``HEIGHT``) rounds, and no row meets all of its ancestors.

Members that end at a node are hashed in numeric order: sorted by range over all
tasks, packed into blobs of ``BLOB`` bytes, and the blobs of a node streamed through one
SHA-256, which holds one blob at a time.

Rows without a conv_id belong to no conversation. Repeated rows are turns of their own.
An empty table gives an empty result. Other columns are not read. Steps are
written to the shared folder when the frame is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ints, parallelism, runs
from shelfline.session import stash

HEADS = 6
FAMILY = 100
HEIGHT = 32
BLOB = 16_384
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2**64
WORD = 1 << 64
KEY = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def head_size(conv_id: Column, heads: int = HEADS) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(heads)).cast("int")


def _unsigned(column: pa.Array) -> np.ndarray:
    return ints(column, 0).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, which may be negative."""
    values, where = np.unique(exponents, return_inverse=True)
    return np.array([pow(base, int(e), WORD) for e in values], np.uint64)[where]


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


# --- places and hashes of the turns --------------------------------------------------------------------------------------


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn among its conversation's turns in this partition, and the hash before and with it."""
    carried, count, sums = None, 0, [np.uint64(0)] * 2
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        conv = ints(batch.column(1), 0)
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        lengths = np.diff(np.append(starts, n))
        _, place = runs(lengths)
        goes_on = conv[0] == carried
        out = {"part": batch.column(0), "conv_id": batch.column(1), "at": place.copy()}
        if goes_on:
            out["at"][: lengths[0]] += count
        last = []
        for i, base in enumerate(BASES):
            with np.errstate(over="ignore"):
                value = _unsigned(batch.column(2 + i)) * _powers(base, int(lengths.max()))[place]
                total = np.cumsum(value, dtype=np.uint64)
                within = total - np.repeat(total[starts] - value[starts], lengths)
                if goes_on:
                    factor = np.uint64(pow(base, count, WORD))
                    first = slice(0, lengths[0])
                    within[first] = within[first] * factor + sums[i]
                    value[first] *= factor
                out[f"p{i + 1}"], out[f"e{i + 1}"] = within, within - value
            last.append(within[-1])
        carried, count, sums = conv[-1], int(out["at"][-1]) + 1, last
        out["chars"] = batch.column(4)
        yield _table(out)


_PLACED = "part int, conv_id long, at long, p1 long, e1 long, p2 long, e2 long, chars long"


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, dict]:
    """The turns with places and hashes inside their partition, and per partition what comes before its first conversation there."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("v1"), F.xxhash64(F.lit(1), role, text).alias("v2"), F.length(text).cast("long").alias("chars")
    ).where(F.col("conv_id").isNotNull())
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("v1"), F.asc("v2")]
    dealt = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    turns = stash(dealt.select(F.spark_partition_id().alias("part"), "conv_id", "v1", "v2", "chars").mapInArrow(_running, _PLACED), "trie-turns")
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "p1", "p2")).alias("last"))
    before: dict[int, tuple] = {}
    carried, count, sums = None, 0, [0, 0]
    for row in sorted(edges.collect(), key=lambda r: r.part):  # one row per partition
        if row.first == carried:
            before[row.part] = (carried, count, *sums)
        goes_on = row.last.conv_id == carried
        found = [p % WORD for p in (row.last.p1, row.last.p2)]
        sums = [(s + p * pow(b, count, WORD)) % WORD for s, p, b in zip(sums, found, BASES, strict=True)] if goes_on else found
        carried, count = row.last.conv_id, row.last.at + 1 + (count if goes_on else 0)
    return turns, before


def _shifted(batch: pa.RecordBatch, before: dict) -> dict:
    """The columns of ``_PLACED``, counted over all partitions."""
    out = {name: ints(batch.column(name), 0).copy() for name in ("part", "conv_id", "at", "chars")}
    for name in ("p1", "e1", "p2", "e2"):
        out[name] = _unsigned(batch.column(name)).copy()
    for part in np.unique(out["part"]):
        if int(part) in before:
            conv, count, *sums = before[int(part)]
            rows = (out["part"] == part) & (out["conv_id"] == conv)
            out["at"][rows] += count
            for i, base in enumerate(BASES):
                for name in (f"p{i + 1}", f"e{i + 1}"):
                    with np.errstate(over="ignore"):
                        out[name][rows] = out[name][rows] * np.uint64(pow(base, count, WORD)) + np.uint64(sums[i])
    return out


def _heads(conversations: DataFrame, turns: DataFrame, before: dict) -> DataFrame:
    """One row per conversation: its size, what it takes from its family, and the family's first turns."""

    def first_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _shifted(batch, before)
            yield _table({name: out[name] for name in ("conv_id", "at", "p1", "e1", "p2", "e2", "chars")})

    most = HEADS - 1
    rows = turns.mapInArrow(first_turns, "conv_id long, at long, p1 long, e1 long, p2 long, e2 long, chars long")
    turn = F.struct("p1", "e1", "p2", "e2", "chars")
    each = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("at") == i, turn)).alias(f"t{i}") for i in range(most)))
    each = stash(each.select("conv_id", "n", F.array(*(f"t{i}" for i in range(most))).alias("turns")), "trie-heads")
    family = each.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"), F.col("turns").alias("family_turns"))
    own = each.select("conv_id", "n", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), head_size(F.col("conv_id")).alias("h"))
    joined = own.join(family, "family", "left").withColumn("taken", F.least("h", F.coalesce(F.col("family_n"), F.lit(0))).cast("int"))

    def hash_of(turns: str, size: str, name: str) -> Column:
        """Hash of the first ``size`` turns; 0 for none."""
        return F.coalesce(F.when(F.col(size) > 0, F.try_element_at(F.col(turns), F.col(size))[name]), F.lit(0).cast("long"))

    return stash(
        joined.select(
            "conv_id", "h", "taken", F.slice(F.col("family_turns"), F.lit(1), F.col("taken")).alias("family_turns"),
            (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
            hash_of("family_turns", "taken", "p1").alias("o1"), hash_of("family_turns", "taken", "p2").alias("o2"),
            hash_of("turns", "h", "p1").alias("q1"), hash_of("turns", "h", "p2").alias("q2"),
        ),
        "trie-heads",
    )


def paths(conversations: DataFrame) -> DataFrame:
    """(``conv_id``, ``depth``, ``k1``, ``k2``, ``j1``, ``j2``, ``chars``, ``ends``): every prefix of every rebuilt conversation.

    j1 and j2 name the prefix one turn shorter; ``ends`` marks the whole conversation.
    """
    turns, before = placed_turns(conversations)
    heads = _heads(conversations, turns, before)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = _shifted(batch, before)
            h, taken, length = (ints(batch.column(c), 0) for c in ("h", "taken", "length"))
            keep = row["at"] >= h
            depth = taken + row["at"] - h + 1
            out = {"conv_id": row["conv_id"], "depth": depth}
            with np.errstate(over="ignore"):
                for i, base in enumerate(BASES):
                    head, own = (_unsigned(batch.column(f"{c}{i + 1}")) for c in "oq")
                    factor = _power(base, taken - h)
                    out[f"k{i + 1}"] = head + (row[f"p{i + 1}"] - own) * factor
                    out[f"j{i + 1}"] = head + (row[f"e{i + 1}"] - own) * factor
            out |= {"chars": row["chars"], "ends": depth == length}
            yield _table({name: values[keep] for name, values in out.items()})

    zero = F.lit(0).cast("long")
    info = ["o1", "o2", "q1", "q2", "h", "taken", "length"]
    own = turns.join(heads.drop("family_turns"), "conv_id").select("part", "conv_id", "at", "p1", "e1", "p2", "e2", "chars", *info)
    # A turn taken from the family already has the hash of its prefix: its head is empty and it stands where it stood.
    taken = heads.select("conv_id", "length", F.posexplode("family_turns").alias("at", "t")).select(
        F.lit(-1).alias("part"), "conv_id", F.col("at").cast("long").alias("at"), *(F.col("t")[c].alias(c) for c in ("p1", "e1", "p2", "e2", "chars")),
        *(zero.alias(c) for c in info[:4]), F.lit(0).alias("h"), F.lit(0).alias("taken"), "length",
    )
    below = own.unionByName(taken).mapInArrow(keyed, "conv_id long, depth long, k1 long, j1 long, k2 long, j2 long, chars long, ends boolean")
    root = heads.select("conv_id", *(zero.alias(c) for c in ("depth", "k1", "j1", "k2", "j2", "chars")), (F.col("length") == 0).alias("ends"))
    return stash(below.unionByName(root), "trie-paths")


# --- the rollup ------------------------------------------------------------------------------------------------------------


def roll_up(nodes: DataFrame, paths: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """Subtree sums of ``values``: ``KEY``, ``conv_id`` and the sums of every node.

    nodes: ``KEY``, ``conv_id`` of a member, ``values``; paths: ``conv_id`` and ``KEY`` of at
    least those members' prefixes.
    """
    if height < 2:
        raise ValueError("a band needs a height of two or more")
    deepest = nodes.agg(F.max("depth")).first()[0]
    band = F.floor(F.col("depth") / height).alias("band")
    above = paths.select(F.col("conv_id").alias("member"), band, F.col("depth").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("up").alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.max("own").alias("conv_id"), *(F.sum(v).alias(v) for v in values))

    pairs = nodes.select("*", band, F.col("conv_id").alias("member")).join(above, ["member", "band"]).where(F.col("up") <= F.col("depth"))
    inside = added(pairs.withColumn("own", F.when(F.col("up") == F.col("depth"), F.col("conv_id"))))
    if deepest is None or deepest < height:
        return inside
    inside = stash(inside, "trie-band")
    at_root = F.col("depth") % height == 0
    flatter = F.floor(F.col("depth") / height).alias("depth")
    tops = roll_up(
        inside.where(at_root).select(flatter, "k1", "k2", "conv_id", *values), paths.where(at_root).select("conv_id", flatter, "k1", "k2"), values, height
    )
    down = tops.where(F.col("depth") > 0).select((F.col("depth") - 1).alias("band"), F.col("conv_id").alias("member"), *values).join(above, ["member", "band"])
    kept = inside.select(F.col("depth").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("own"), *values)
    return added(kept.unionByName(down.select("up", "u1", "u2", F.lit(None).cast("long").alias("own"), *values)))


# --- members that end at a node ------------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of comma-joined members of one node, from rows sorted by node and member."""
    node, first, parts, size = None, 0, [], 0
    ready: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True)) if ready else [[]] * 5
        ready.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], [*KEY, "first", "blob"])

    for batch in batches:
        for depth, k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, k1, k2) != node or size > BLOB:
                if parts:
                    ready.append((*node, first, ",".join(parts).encode()))
                    if len(ready) >= 1024:
                        yield flush()
                node, first, parts, size = (depth, k1, k2), conv, [], 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
    if parts:
        ready.append((*node, first, ",".join(parts).encode()))
    yield flush()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blobs of each node, from rows sorted by node and first member."""
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, k1, k2, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if (depth, k1, k2) != node:
                if digest is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(blob)
        if done:
            yield _hashes(done)
    if digest is not None:
        yield _hashes([(*node, digest.hexdigest())])


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def end_hashes(paths: DataFrame) -> DataFrame:
    """``KEY`` and ``ends_sha256`` of every node at which a conversation ends."""
    order = [*KEY, "conv_id"]
    ends = paths.where("ends").select(*order)
    blobs = ends.repartitionByRange(parallelism(paths.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_packed, "depth long, k1 long, k2 long, first long, blob binary")
    return blobs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digested, "depth long, k1 long, k2 long, ends_sha256 string")


# --- the operator ----------------------------------------------------------------------------------------------------------


def trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    rows = paths(conversations)
    nodes = stash(
        rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("j1").alias("j1"), F.max("j2").alias("j2"), F.max("chars").alias("chars")), "trie-nodes"
    )
    below = nodes.where(F.col("depth") > 0)
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stash(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce(F.col("n_children"), F.lit(0).cast("long"))), "trie-nodes")
    values = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = roll_up(values, rows, ["n_leaves", "saved_tokens"], height).drop("conv_id")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, KEY).join(end_hashes(rows), KEY, "left").join(parent, ["depth", "j1", "j2"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )
