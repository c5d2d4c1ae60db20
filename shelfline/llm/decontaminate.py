r"""Benchmark decontamination with suffix arrays over the training shards.

1. Test windows. Every window of ten words of an item (an item with fewer is one window) becomes a row
   of a written table, with its word hashes, item and place. A bitmap of all windows, ``BITS_PER_WINDOW``
   bits each and ``MOST_BITS`` at most, is the only thing broadcast, whatever the size of the benchmark.
2. Shards. One pass marks the documents that may hold a window and writes them, cut into shards of
   about ``SHARD_BYTES`` of text by the tasks that read them, so no key decides the size of a shard. The
   bitmap only proposes: a fuller one sends more clean documents on the same way.
3. Each distinct window of a shard meets the test table once. A shard's suffixes (one per word) are
   sorted into a suffix array and every test suffix that came is looked up by binary search, which
   gives all its verbatim occurrences; matches on one diagonal are joined to the longest ones.
4. A second pass reports (or keeps) the documents that were not marked. The number of passes and of
   operators in the plan is the same for every benchmark.

Words: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Words are compared by 64-bit
hashes. A null or empty text has no words: as a document it is clean, as an item it has no window. A null
``item_id`` matches like others and is listed as the empty string; an id on several rows counts once.
Equal rows are judged alike. An empty benchmark leaves every document clean. Other columns of the inputs
are never read. ``report`` and ``clean`` write the test windows and the marked documents when called; the
documents are read twice, so they must be the same rows both times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm import common
from shelfline.session import stash

WINDOW = 10
SHARD_BYTES = 16 << 20  # of marked text in a shard
BITS_PER_WINDOW = 64
MOST_BITS = 1 << 28  # of the broadcast bitmap, 32 MiB
PROBES = 6
_STEP = 0xD6E8FEB86659FD93


# --- test windows and their bitmap ----------------------------------------------------------------------------------------


def _cut(window: int) -> object:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = common.byte_classes("alnum")
        for batch in common.slices(batches, 2):
            hashes, offsets = common.words(*common.flat(batch.column(2)), classes)
            n = np.diff(offsets)
            size = np.minimum(n, window)
            row, at = common.runs(np.where(n > 0, n - size + 1, 0))
            for s in np.unique(size[row]):
                every = np.flatnonzero(size[row] == s)
                for k in range(0, len(every), 1 << 16):
                    own = every[k : k + (1 << 16)]
                    words = np.ascontiguousarray(hashes[(offsets[row[own]] + at[own])[:, None] + np.arange(s)])
                    code = np.zeros(len(own), np.uint64)
                    for t in range(s):
                        code = code * np.uint64(_STEP) + words[:, t]
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * int(s)), len(own), [None, pa.py_buffer(words.tobytes())])
                    take = pa.array(row[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(common.mix(code + np.uint64(s)).view(np.int64)), pa.array(np.full(len(own), s, np.int32)), fixed.cast(pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(at[own].astype(np.int32))],
                        names=["code", "size", "words", "item", "text_hash", "at"],
                    )

    return cut


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of every item: ``code`` (a hash), ``size``, ``words`` (their hashes), ``item``, ``text_hash``, ``at``."""
    text = F.coalesce("text", F.lit(""))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return items.mapInArrow(_cut(window), "code long, size int, words binary, item string, text_hash long, at int")


def _probe(code: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th of a code's places in a bitmap of ``2 ** bits``."""
    return (common.mix(code + np.uint64((k + 1) * _STEP % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _slots(bits: int) -> object:
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = common.ints(batch.column(0), 0).view(np.uint64)
            if len(code):
                place = np.sort(np.concatenate([_probe(code, k, bits) for k in range(PROBES)]))
                first = common.group_bounds(place >> 6)[:-1]
                word = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array((place[first] >> 6).astype(np.int32)), pa.array(word.view(np.int64))], names=["slot", "word"])

    return slots


def bitmap(tests: DataFrame, most_bits: int = MOST_BITS) -> tuple[tuple[int, ...], int, np.ndarray]:
    """(sizes of the windows, log2 of the bits, the bitmap of all windows)."""
    counts = {r["size"]: r["count"] for r in tests.groupBy("size").count().collect()}  # as many rows as sizes, ten at most
    bits = max(6, min(most_bits, max(1 << 16, BITS_PER_WINDOW * sum(counts.values()))).bit_length() - 1)
    found = tests.select("code").mapInArrow(_slots(bits), "slot int, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[common.ints(found["slot"], 0)] = common.ints(found["word"], 0).view(np.uint64)
    return tuple(sorted(counts)), bits, marks


# --- marking documents ------------------------------------------------------------------------------------------------------


def proposed(hashes: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of the windows of some texts that the bitmap may hold."""
    ahead = np.concatenate([hashes, np.zeros(max(sizes, default=0), np.uint64)])
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(hashes))  # words up to the end of the text
    code = np.zeros(len(hashes), np.uint64)
    words, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for t in range(max(sizes, default=0)):
        code = code * np.uint64(_STEP) + ahead[t : t + len(hashes)]
        if t + 1 in sizes:
            at = np.flatnonzero(room > t)
            own = common.mix(code[at] + np.uint64(t + 1))
            for k in range(PROBES):
                place = _probe(own, k, bits)
                held = (marks[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                at, own = at[held], own[held]
            words.append(at)
            codes.append(own)
    return np.concatenate(words), np.concatenate(codes)


def _mark(shared: Broadcast, shard_bytes: int) -> object:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents that may hold a test window, with their shard and the distinct codes of these windows."""
        sizes, bits, marks = shared.value
        classes = common.byte_classes("alnum")
        shard, held = TaskContext.get().partitionId() << 32, 0
        for batch in common.slices(batches, common.row_text):
            data, starts = common.flat(common.row_text(batch))
            hashes, offsets = common.words(data, starts, classes)
            at, codes = proposed(hashes, offsets, sizes, bits, marks)
            if len(at) == 0:
                continue
            row = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((codes, row))
            row, codes = row[order], codes[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
            row, codes = row[new], codes[new]
            bounds = common.group_bounds(row)
            own = row[bounds[:-1]]
            size = np.diff(starts)[own]
            in_shard = shard + (held + np.cumsum(size) - size) // shard_bytes
            held += int(size.sum())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(in_shard), lists], names=["row", "shard", "codes"])

    return mark


def _unmarked(shared: Broadcast, finish) -> object:
    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits, marks = shared.value
        classes = common.byte_classes("alnum")
        for batch in common.slices(batches, common.row_text):
            hashes, offsets = common.words(*common.flat(common.row_text(batch)), classes)
            at, _ = proposed(hashes, offsets, sizes, bits, marks)
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(offsets, at, "right") - 1] = False
            own = np.flatnonzero(clean)
            yield finish(batch.column(0).take(pa.array(own)), np.diff(offsets)[own], [None] * len(own))

    return unmarked


# --- suffix arrays of the shards ------------------------------------------------------------------------------------------------


def compile_windows(found: pa.Table, window: int = WINDOW) -> dict:
    """Vocabulary and distinct windows of some rows of ``test_windows``.

    A window is a row of word ids, padded with zeros to ``window``; ``owners`` lists the
    (item, word offset) pairs that hold it.
    """
    data, offsets = common.flat(found["words"])
    vocabulary, ids = np.unique(data.copy().view(np.uint64), return_inverse=True)
    ids, offsets = (ids + 1).astype(">u4"), offsets // 8
    names: dict[tuple[str, int], int] = {}
    owners: dict[bytes, set[tuple[int, int]]] = {}
    for r, (item, text_hash, at) in enumerate(zip(found["item"].to_pylist(), found["text_hash"].to_pylist(), found["at"].to_pylist(), strict=True)):
        owners.setdefault(ids[offsets[r] : offsets[r + 1]].tobytes(), set()).add((names.setdefault((item, text_hash), len(names)), at))
    keys = sorted(owners)
    sizes = np.array([len(k) // 4 for k in keys], np.int64)
    width = max(1, len(vocabulary).bit_length())
    lead = max(1, min(63 // width, window))
    leads: dict[int, set[int]] = {}
    for key, size in zip(keys, np.minimum(sizes, lead), strict=True):
        value = 0
        for x in np.frombuffer(key, ">u4", size):
            value = (value << width) | int(x)
        leads.setdefault(int(size), set()).add(value)
    ends = [k + b"\xff" * (4 * window - len(k)) for k in keys]
    return {
        "width": width,
        "leads": {size: np.array(sorted(own), np.int64) for size, own in leads.items()},  # first words of all windows, in one number
        "range": (np.array(keys, f"S{4 * window}"), np.array(ends, f"S{4 * window}")),
        "names": [item for item, _ in names],
        "vocabulary": vocabulary,
        "keys": keys,
        "sizes": sizes,
        "owners": [sorted(owners[k]) for k in keys],
        "window": window,
    }


def shard_matches(ids: np.ndarray, tests: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence of a test window in a shard.

    ``ids`` holds test word ids, 0 for other words and between documents. Only suffixes
    whose first words start some test window enter the array; the others cannot match.
    """
    ahead = np.concatenate([ids, np.zeros(tests["window"], np.int64)])
    keep = np.zeros(len(ids), bool)
    for size, wanted in tests["leads"].items():
        code = np.zeros(len(ids), np.int64)
        for t in range(size):
            code = (code << tests["width"]) | ahead[t : t + len(ids)]
        place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        keep |= wanted[place] == code
    starts = np.flatnonzero(keep)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = ahead[starts[:, None] + np.arange(tests["window"])].astype(">u4")
    prefix = np.ascontiguousarray(prefix).view(f"S{4 * tests['window']}").ravel()
    array = np.argsort(prefix, kind="stable")  # the shard's suffix array
    ordered = prefix[array]
    low, high = (np.searchsorted(ordered, edge, side) for edge, side in zip(tests["range"], ("left", "right"), strict=True))
    which, inside = common.runs(high - low)
    return starts[array[low[which] + inside]], which


def longest(pairs: list[tuple[int, int, int, int]], sizes: np.ndarray, names: list[str]) -> tuple[int, int, str]:
    """(-words, document word, item) of the longest verbatim match: neighbouring windows on one diagonal join.

    Of equally long matches the one that starts first counts, then the smallest item.
    """
    best = (0, 0, "")
    ends: dict[tuple[int, int], tuple[int, int]] = {}
    for p, w, i, j in sorted(pairs):
        last, start = ends.get((i, p - j), (-2, p))
        start = start if last == p - 1 else p
        ends[(i, p - j)] = (p, start)
        best = min(best, (int(start - p - sizes[w]), int(start), names[i]))
    return best


def _judge(text: pa.Array, tests: dict | None) -> tuple[np.ndarray, list[tuple | None]]:
    """(words of each text; for those with a match: words hit, items, and the longest match)."""
    hashes, offsets = common.words(*common.flat(text), common.byte_classes("alnum"))
    rows, found = len(text), [None] * len(text)
    if tests is None or rows == 0:
        return np.diff(offsets), found
    vocabulary = tests["vocabulary"]
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    ids = np.where(vocabulary[place] == hashes, place + 1, 0)
    # one 0 after each document, so that no window crosses into the next
    starts = offsets[:-1] + np.arange(rows)
    at, which = shard_matches(np.insert(ids, offsets[1:], 0), tests)
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((which, at, doc))
    at, which, doc = at[order], which[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[r], bounds[r + 1])
        position, window = at[own] - starts[r], which[own]
        edges = np.zeros(offsets[r + 1] - offsets[r] + 1, np.int64)
        np.add.at(edges, position, 1)
        np.add.at(edges, position + tests["sizes"][window], -1)
        pairs = [(int(p), int(w), i, j) for p, w in zip(position, window, strict=True) for i, j in tests["owners"][w]]
        length, start, item = longest(pairs, tests["sizes"], tests["names"])
        found[r] = (int((np.cumsum(edges[:-1]) > 0).sum()), sorted({tests["names"][i] for _, _, i, _ in pairs}), -length, item, start)
    return np.diff(offsets), found


def _search(window: int, finish) -> object:
    def search(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        """Of one shard: its documents judged by the test windows that it may hold."""
        tests = compile_windows(found, window) if found.num_rows else None
        out = []
        for batch in common.slices(iter(docs.select(["row"]).to_batches()), common.row_text):
            out.append(finish(batch.column(0), *_judge(common.row_text(batch), tests)))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([finish(docs["row"].combine_chunks(), np.zeros(0, np.int64), [])])

    return search


# --- the operator -----------------------------------------------------------------------------------------------------------

_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match int, match_item string, match_start int"


def _counts(row: pa.StructArray, n_words: np.ndarray, found: list[tuple | None]) -> pa.RecordBatch:
    none = (0, [], None, None, None)
    hit, items, length, item, start = zip(*(f or none for f in found), strict=True) if found else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [
            row.field("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
            pa.array(length, pa.int32()), pa.array(item, pa.string()), pa.array(start, pa.int32()),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_item", "match_start"],
    )


def _kept(row: pa.StructArray, n_words: np.ndarray, found: list[tuple | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row.filter(pa.array([f is None for f in found], pa.bool_()))], names=["row"])


def _run(rows: DataFrame, benchmark: DataFrame, finish, schema: T.StructType | str, window: int, shard_bytes: int, most_bits: int) -> DataFrame:
    tests = stash(test_windows(benchmark, window), "test-windows")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(tests, most_bits))
    marked = stash(rows.mapInArrow(_mark(shared, shard_bytes), common.schema_of(rows, "row", shard=T.LongType(), codes=T.ArrayType(T.LongType()))), "marked-documents")
    met = marked.select(F.col("shard").alias("of"), F.explode("codes").alias("code")).distinct().join(tests.drop("size"), "code").drop("code")
    judged = marked.select("shard", "row").groupBy("shard").cogroup(met.groupBy("of")).applyInArrow(_search(window, finish), schema)
    return rows.mapInArrow(_unmarked(shared, finish), schema).unionAll(judged)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: word and hit counts, the items found and the longest match with its place."""
    rows = docs.select(common.whole_row(["doc_id", "text"]))
    return _run(rows, benchmark, _counts, _REPORT, window, shard_bytes, most_bits)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents without a verbatim match, with all their columns."""
    rows = docs.select(common.whole_row(docs.columns))
    return _run(rows, benchmark, _kept, rows.schema, window, shard_bytes, most_bits).select("row.*")
