"""How filters interact: what each would remove in every order of applying them.

Five filters judge every whole text (null: empty; words lie between the characters 0x20 and
0x09-0x0D). A document fails A with fewer than ``MIN_WORDS`` words, B if under half its words are distinct, C if
over 3 % of its code points are A-Z, D if it holds any of ``#$%&*|``, E if a document of smaller doc_id has the same text. A
document without doc_id neither fails E nor makes another one fail it; documents of equal doc_id
do not make each other fail.

Truth-table words: a document that fails the set f of filters survives exactly the subsets s
that share no filter with f, so bit s of a 32-bit word says whether it survives s. Tasks add
up the bits of all words per part and labels by carry-save adders: three words become one word of sums and
one of carries of twice the weight, until one word of each weight is left. These 32 counts per part and label
hold all the report needs, whatever the order: what an order keeps after a step is
the count of the subset of its first filters.

Equal texts are found by 128-bit BLAKE2 digests. The first of each text is joined by digest and
doc_id together and labels by doc_id (by digest where it is null), so a text or a
missing id that a third of the documents have makes no large group. Several label rows of a document count as one
that holds any of their marks. Empty tables give an empty result. Other columns are not read. Verdicts are written to the
shared folder when the frame is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import byte_classes, flat, runs, slices, words
from shelfline.session import stash

LETTERS = "ABCDE"
MIN_WORDS = 200
MARKS = b"#$%&*|"
BLOCK_ROWS = 65_536  # words that are added up at once
HELD = 4_096  # groups whose counts a task holds before it passes them on


# --- verdicts of the filters -----------------------------------------------------------------------------------------------


def _cased() -> np.ndarray:
    """Word classes that keep the case."""
    out = byte_classes("space")
    out[65:91] = np.arange(65, 91)
    return out


def _kinds() -> np.ndarray:
    """Bit 1: A-Z, bit 2: first byte of a code point, bit 4: one of ``MARKS``."""
    out = np.zeros(256, np.uint8)
    out[65:91] |= 1
    out[:128] |= 2
    out[192:] |= 2
    out[list(MARKS)] |= 4
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes, kinds = _cased(), _kinds()
    for batch in slices(batches, 2):
        data, offsets = flat(batch.column(2))
        hashes, bounds = words(data, offsets, classes)
        kind = kinds[data]
        fails, digests = np.zeros(batch.num_rows, np.int32), []
        for i in range(batch.num_rows):
            own = kind[offsets[i] : offsets[i + 1]]
            n = int(bounds[i + 1] - bounds[i])
            distinct = len(np.unique(hashes[bounds[i] : bounds[i + 1]]))
            points, upper = np.count_nonzero(own & 2), np.count_nonzero(own & 1)
            fails[i] = (n < MIN_WORDS) | (100 * distinct < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | bool((own & 4).any()) << 3
            digests.append(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` and ``fails`` of every document: bit k is set if it fails the k-th of ``LETTERS``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    own = stash(rows.mapInArrow(_judged, "doc_id long, part string, fails int, digest binary"), "audit-verdicts")
    first = own.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return own.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", "digest", F.col("fails").bitwiseOR(F.when(later, 16).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` (quality 1) and ``toxic`` (toxic 1); false where a document has no label."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return joined.select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


# --- truth-table words and their sums ------------------------------------------------------------------------------------


def truth_words(filters: int = len(LETTERS)) -> np.ndarray:
    """For every set of failed filters, the word whose bit s is set if a document survives the subset s."""
    subsets = np.arange(1 << filters)
    survives = (subsets[:, None] & subsets[None, :]) == 0
    return (survives.astype(np.uint64) << subsets.astype(np.uint64)).sum(1).astype(np.uint32)


def positional_popcounts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of 32 bits is set in each group of ``values``; consecutive groups have the given sizes."""
    bits = np.arange(32, dtype=np.uint32)
    counts, weight = np.zeros((len(sizes), 32), np.int64), 1
    values, sizes = values.astype(np.uint32), np.asarray(sizes, np.int64)
    while len(values):
        carries, groups = [], []
        while sizes.max() > 1:
            start, triples = np.cumsum(sizes) - sizes, -(-sizes // 3)
            group, place = runs(triples)
            at, end = start[group] + 3 * place, (start + sizes)[group]
            a, (b, c) = values[at], (np.where(at + k < end, values[np.minimum(at + k, len(values) - 1)], np.uint32(0)) for k in (1, 2))
            half = a ^ b
            carry = (a & b) | (half & c)
            carries.append(carry[carry != 0])
            groups.append(group[carry != 0])
            values, sizes = half ^ c, triples
        counts[sizes > 0] += weight * ((values[:, None] >> bits) & 1).astype(np.int64)
        weight *= 2
        group = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        order = np.argsort(group, kind="stable")
        values = np.concatenate(carries)[order] if carries else np.zeros(0, np.uint32)
        sizes = np.bincount(group, minlength=len(sizes))
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, held = truth_words(), {}

    def add(waiting: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(waiting)
        part = pc.dictionary_encode(rows.column("part").combine_chunks())
        good, toxic, fails = (rows.column(c).to_numpy().astype(np.int64) for c in ("good", "toxic", "fails"))
        group = part.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
        order = np.argsort(group, kind="stable")
        present, sizes = np.unique(group, return_counts=True)
        names = part.dictionary.to_pylist()
        for g, counts in zip(present.tolist(), positional_popcounts(table[fails[order]], sizes), strict=True):
            key = (names[g // 4], bool(g & 2), bool(g & 1))
            held[key] = held[key] + counts if key in held else counts

    def passed_on() -> pa.RecordBatch:
        keys = list(zip(*held, strict=True)) if held else [[], [], []]
        counts = pa.array([c.tolist() for c in held.values()], pa.list_(pa.int64()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.bool_()), pa.array(keys[2], pa.bool_()), counts], ["part", "good", "toxic", "counts"])

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            add(waiting)
            waiting, n = [], 0
            if len(held) > HELD:
                yield passed_on()
    if n:
        add(waiting)
    yield passed_on()


def survivors(rows: DataFrame) -> DataFrame:
    """``part``, ``subset`` (bit k: the k-th filter is applied), ``n``, ``good``, ``toxic``: documents of a part that survive a subset.

    rows: ``part``, ``fails``, ``good``, ``toxic``.
    """
    counts = rows.select("part", "fails", "good", "toxic").mapInArrow(_counted, "part string, good boolean, toxic boolean, counts array<bigint>")
    each = counts.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    none = F.lit(0).cast("long")
    return each.groupBy("part", "subset").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(none)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(none)).alias("toxic")
    )


# --- the report ------------------------------------------------------------------------------------------------------------


def _orders(letters: str) -> pd.DataFrame:
    """Every step of every order, with the subsets applied before and after it and its own filter."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, k, before, before | 1 << k))
            before |= 1 << k
    return pd.DataFrame(rows, columns=["filter_order", "step", "filter", "before", "after"])


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step; rows as for ``survivors``."""
    full = (1 << len(letters)) - 1

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = _orders(letters)
        own, before, after = (steps[c].to_numpy() for c in ("filter", "before", "after"))
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                n, good, toxic = np.array([[c["n"], c["good"], c["toxic"]] for c in counts], np.int64).T
                removed = n[before] - n[after]
                fails = n[0] - n[1 << own]
                yield pd.DataFrame(
                    {
                        "part": part, "filter_order": steps["filter_order"], "step": steps["step"].astype(np.int32), "kept": n[after], "removed": removed, "redundant": fails - removed,
                        "unique_fails": n[full & ~(1 << own)] - n[full], "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after],
                        "shapley": np.array([removed[own == k].sum() for k in range(len(letters))])[own],
                    }
                )

    counts = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("counts")  # 2 ** filters of each part
    return survivors(rows).groupBy("part").agg(counts).mapInPandas(report, _REPORT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs``, in which ``labels`` mark good and toxic documents."""
    return audit(with_labels(verdicts(docs), labels))
