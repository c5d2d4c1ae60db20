"""What several operators share: table access, vectorised word hashing, packed blobs."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20  # bytes of text that are hashed at once
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(columns: list[str]) -> Column:
    """All of ``columns`` in one struct named ``row``, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")


def schema_of(df: DataFrame, *columns: str, **more: T.DataType) -> T.StructType:
    """A schema of some columns of ``df`` and further ones."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns] + [T.StructField(c, kind) for c, kind in more.items()])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(spark: SparkSession, n_bytes: int, target: int = 16 << 20) -> int:
    """Number of hash chunks of about ``target`` bytes of text each, and no fewer than there are shuffle partitions."""
    return max(parallelism(spark), math.ceil(n_bytes / target))


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of ``text``; one number."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


# --- text columns as flat byte buffers ---------------------------------------------------------------------------------


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a text column, row offsets); a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_text(batch: pa.RecordBatch) -> pa.Array:
    """The text inside a ``row`` column, which comes first."""
    return batch.column(0).field("text")


def slices(batches: Iterator[pa.RecordBatch], column: int | Callable, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut into pieces of about ``limit`` bytes of the text in ``column`` (at least one row each)."""
    for batch in batches:
        text = column(batch) if callable(column) else batch.column(column)
        sizes = text.cast(pa.large_binary())
        offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def kept() -> dict:
    """A dictionary of the Python process. Functions reach workers by value, so a global of
    this module would be made anew for each task and stay until the garbage collector comes."""
    return sys.__dict__.setdefault("_shelfline_kept", {})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of them, and the value of each byte."""
    tables = kept().get("powers")
    if tables is None or len(tables[0]) < n:
        made = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(max(n, BLOCK + 4096), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        tables = (*made, _byte_values())
        if n <= 4 * BLOCK:  # larger ones, for a very long word, do not stay
            kept()["powers"] = tables
    return tables


def byte_values() -> np.ndarray:
    return _powers(1)[2]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial hash modulo 2**64; entry i covers the bytes before i."""
    up, _, values = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    _, down, _ = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def span_hashes_blockwise(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of short spans anywhere in ``data``, with running sums over one block at a time."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable") if len(starts) and (np.diff(starts) < 0).any() else np.arange(len(starts))
    ordered = starts[order]
    at = 0
    while at < len(order):
        base = ordered[at]
        stop = int(np.searchsorted(ordered, base + BLOCK, "left"))
        own = order[at:stop]
        out[own] = span_hashes(prefix_sums(data[base : ends[own].max()]), starts[own] - base, ends[own] - base)
        at = stop
    return out


def byte_classes(kind: str) -> np.ndarray:
    """Lookup of 256 bytes: 0 separates, other values are the byte with A-Z lower-cased.

    ``alnum``: words of digits, letters and all bytes above ASCII. ``space``: words between
    the characters 0x20 and 0x09-0x0D.
    """
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    if kind == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
        out[~keep] = 0
        return out
    out[0] = 255  # a byte that UTF-8 never has, so that NUL stays a character
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, row offsets into them); with ``first``, of the word's first bytes only.

    Works through blocks cut at separators or row ends, so memory is bounded whatever the length of a
    text; a word longer than a block is hashed piece by piece. Two different words share a hash with probability 2**-64.
    """
    hashes, starts_all = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        part = classes[data[at:end]]
        if end < n:  # no word may go on beyond the block
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row <= at and part.all():
                size, value = _long_word(data, at, int(offsets[np.searchsorted(offsets, at, "right")]), classes)
                if first is not None:
                    value = int(span_hashes(prefix_sums(part[:first]), np.array([0]), np.array([first]))[0])
                hashes.append(np.array([value], np.uint64))
                starts_all.append(np.array([at]))
                at += size
                continue
            zeros = np.flatnonzero(part == 0)
            end = max(row, at + int(zeros[-1]) + 1 if len(zeros) else 0)
            part = part[: end - at]
        inside = part != 0
        edge = np.zeros(len(part) + 1, bool)
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        edge[rows] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(last) + 1
        if first is not None:
            ends = np.minimum(ends, starts + first)
        if len(starts):
            hashes.append(span_hashes(prefix_sums(part), starts, ends))
            starts_all.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets)


def _long_word(data: np.ndarray, at: int, limit: int, classes: np.ndarray) -> tuple[int, int]:
    """(bytes, hash) of the word that starts at ``at`` and ends before ``limit`` or a separator; the hash that ``span_hashes`` gives."""
    up, _, values = _powers(BLOCK)
    total, size = 0, 0
    while at + size < limit:
        part = classes[data[at + size : min(limit, at + size + BLOCK)]]
        stop = np.flatnonzero(part == 0)
        own = part[: stop[0]] if len(stop) else part
        own_sum = int((values[own] * up[: len(own)]).sum(dtype=np.uint64))
        total = (total + own_sum * pow(_MULTIPLIER, size, 1 << 64)) % (1 << 64)
        size += len(own)
        if len(stop):
            break
    return size, int(mix(np.array([total], np.uint64))[0])


# --- packed arrays -----------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed blob."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(8)
        parts += [code, np.array([len(a)], np.int64).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    at, shapes, out = 8, [], []
    for _ in range(count):
        shapes.append((np.dtype(raw[at : at + 8].decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])))
        at += 16
    for kind, n in shapes:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def ints(column: pa.Array | pa.ChunkedArray, null: int) -> np.ndarray:
    """An integer column as int64, with ``null`` in place of nulls."""
    column = column.cast(pa.int64()).fill_null(null)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def group_bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal neighbours, with the length at the end."""
    if len(sorted_keys) == 0:
        return np.zeros(1, np.int64)
    change = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], change, [len(sorted_keys)]])


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive runs of the given lengths: (run of each entry, place of each entry in its run)."""
    lengths = np.asarray(lengths, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - start[run]
