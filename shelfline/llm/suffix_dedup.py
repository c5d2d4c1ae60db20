r"""Suffix-array dedup: removes every byte that a long enough earlier repetition covers.

A string of ``LENGTH`` (100) bytes that also starts earlier in the corpus, in a document of a
smaller id or further left in the same one, covers its bytes; all covered bytes go.
Matches never cross documents and are judged on the input.

1. Suffixes. Every window of 100 bytes picks one suffix start in it, the leftmost of the
   smallest hashes of its 32-byte strings, so equal windows pick it at the same distance.
   About one suffix in 35 is picked: a sparse suffix array suffices to meet every repeated
   window. A record is a picked suffix with the range of windows that picked it.
2. Range partition. Splitters drawn from sampled suffixes by their leading 8-byte token
   deal the records into buckets. Inside a bucket a multikey quicksort orders suffixes
   token by token, touching only those still tied; ties through all tokens are candidates.
   Equal leading tokens fall on one side of every splitter, so no run of equal suffixes
   crosses a boundary. Each task sends a repeated suffix once, with a mark, so a passage
   that a third of all rows share is one record per task.
3. Windows. Candidates come back to their texts, grouped in chunks by hash. The windows
   of repeated suffixes are cut out and dealt by the same splitters; equal cuts within a
   chunk are sent once. In a bucket a multikey quicksort on (leading token, rest) groups
   the windows, whole bytes are compared, and all but the earliest of a group are reported.
   A short passage that very many texts hold between different neighbours would fill one
   bucket with distinct cuts. Such suffixes (``HOT_CONTEXTS`` contexts, counted while splitters
   are sampled) have their windows dealt singly, by hashes of all 100 bytes, each distinct
   window once per chunk, so that only equal windows meet.
4. The covered bytes of a document are the union of its reported windows.

Order of windows: (doc_id, 64-bit hash of the text, start); a null id comes before all
others. Rows equal in id and text are one document of which all further copies are
repetitions in whole (if 100 bytes or longer). Null and empty texts, and texts shorter than 100
bytes, lose nothing. An empty table gives an empty result. Other columns are not read.
Candidates are found by 8 leading bytes and 32-bit hashes of the next 24; windows by 64-bit
hashes; both only propose, bytes decide. Windows dealt singly are compared by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm import common
from shelfline.session import stash

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # suffix starts that a window offers
SAMPLE = 4_096  # sampled suffixes that set the splitters
PER_TASK = 64
HOT_CONTEXTS = 2_048  # contexts from which on the windows of a suffix are dealt singly
HOT_GRAMS = 1 << 17  # such suffixes that are broadcast, those with the most contexts; all others go the usual way
_NULL_ID = -(1 << 63)
_SEGMENT = 1 << 20


# --- picked suffixes ---------------------------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position, by doubling."""
    h = common.byte_values()[data]
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & ((1 << 64) - 1)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbours from each position, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def picks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first window, last window) of the picked suffixes of several texts laid end to end; all positions in ``data``."""
    starts, firsts, lasts = [], [], []
    for at in range(0, len(data), _SEGMENT):
        part = data[at : at + _SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        h = _gram_hashes(part)
        packed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        pick = (_sliding_min(packed, SPAN) & np.uint64((1 << 24) - 1)).astype(np.int64)  # for each window start
        # windows that stay within one text: no text ends before the window does
        ends = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + len(part), "right")] - at
        bad = np.zeros(len(pick) + 1, np.int64)
        inner = ends[ends < len(part)]
        np.add.at(bad, np.clip(inner - LENGTH + 1, 0, len(pick)), 1)
        np.add.at(bad, np.clip(inner, 0, len(pick)), -1)
        valid = np.cumsum(bad[:-1]) == 0
        change = np.ones(len(pick), bool)
        change[1:] = (pick[1:] != pick[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(pick)) - 1
        good = valid[first]
        starts.append(pick[first[good]] + at)
        firsts.append(first[good] + at)
        lasts.append(last[good] + at)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(starts), join(firsts), join(lasts)


def tokens(data: np.ndarray, starts: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` 8-byte tokens from each start, as numbers in byte order; the bytes must be there."""
    out = np.empty((len(starts), count), np.uint64)
    for c in range(count):
        value = np.zeros(len(starts), np.uint64)
        for i in range(8):
            value = (value << np.uint64(8)) | data[starts + (8 * c + i)].astype(np.uint64)
        out[:, c] = value
    return out


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each ordered row): rows sorted by the columns in turn, groups tied in all of them.

    Multikey quicksort, one token at a time over all open groups: after each token only the
    rows that are still tied go on.
    """
    n = len(columns[0])
    order = np.argsort(columns[0])
    key = columns[0][order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    for column in columns[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        group = np.cumsum(new)[at]
        key = column[order[at]]
        by = np.lexsort((key, group))
        order[at] = order[at[by]]
        key, group = key[by], group[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[at] = fresh
    return order, np.cumsum(new) - 1


# --- the four steps as functions of Arrow batches --------------------------------------------------------------------------------

_KEYED = "bucket int, chunk int, kind string, blob binary"


def _rows(parts: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
    bucket, chunk, kind, blob = zip(*parts, strict=True) if parts else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int32()), pa.array(kind, pa.string()), pa.array(blob, pa.binary())], names=["bucket", "chunk", "kind", "blob"])


def _by_chunk(buckets: int, kind: str, chunks: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, str, bytes]]:
    """Rows addressed to text chunks; on their way they pass through some bucket, spread evenly by chunk."""
    order = np.argsort(chunks, kind="stable")
    bounds = common.group_bounds(chunks[order])
    return [(int(chunks[order[i]]) % buckets, int(chunks[order[i]]), kind, common.pack(*(c[order[i:j]] for c in columns))) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _shared_grams(grams: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, its distinct contexts) of the grams with several contexts."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram, context = np.concatenate(grams), np.concatenate(contexts)
    order, group = multikey_sort([gram, context])
    distinct = gram[order][common.group_bounds(group)[:-1]]
    bounds = common.group_bounds(distinct)
    count = np.diff(bounds)
    return distinct[bounds[:-1]][count > 1], count[count > 1]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading tokens of the ``PER_TASK`` picked suffixes with the smallest hashes, and grams with several contexts.

    Contexts are counted in batches of about two million suffixes, so memory is bounded.
    """

    def rows(token: np.ndarray, draw: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64), pa.int64()), pa.array(draw.view(np.int64), pa.int64()), pa.array(contexts, pa.int64())], names=["token", "draw", "contexts"])

    kept: np.ndarray = np.zeros(0, np.uint64)
    grams: list[np.ndarray] = []
    contexts: list[np.ndarray] = []
    for batch in common.slices(batches, 0, 1 << 20):
        data, offsets = common.flat(batch.column(0))
        starts, firsts, lasts = picks(data, offsets)
        both = np.concatenate([kept, tokens(data, starts)[:, 0]])
        kept = both[np.argsort(common.mix(both + np.arange(len(both), dtype=np.uint64)), kind="stable")[:PER_TASK]]
        grams.append(common.span_hashes_blockwise(data, starts, starts + GRAM))
        contexts.append(common.span_hashes_blockwise(data, firsts, lasts + LENGTH))
        if sum(map(len, grams)) > 1 << 21:
            gram, count = _shared_grams(grams, contexts)
            yield rows(gram, np.zeros(len(gram), np.int64), count)
            grams, contexts = [], []
    gram, count = _shared_grams(grams, contexts)
    yield rows(gram, np.zeros(len(gram), np.int64), count)
    yield rows(kept, common.mix(kept), np.zeros(len(kept), np.int64))


def splitters(docs: DataFrame, buckets: int, hot_contexts: int = HOT_CONTEXTS) -> tuple[np.ndarray, np.ndarray]:
    """(upper ends of the buckets' leading tokens, from a bounded sample; hashes of the grams with very many contexts)."""
    seen = stash(docs.select("text").mapInArrow(_sample, "token long, draw long, contexts long"), "suffix-sample")
    sample = seen.where("contexts = 0").orderBy("draw", "token").limit(SAMPLE).collect()
    shared = seen.where("contexts > 0").groupBy("token").agg(F.sum("contexts").alias("contexts")).where(F.col("contexts") >= hot_contexts)
    hot = shared.orderBy(F.desc("contexts"), "token").limit(HOT_GRAMS).collect()
    grams = np.sort(np.array([r.token for r in hot], np.int64).view(np.uint64))
    drawn = np.sort(np.array([r.token for r in sample], np.int64).view(np.uint64))
    if len(drawn) == 0 or buckets < 2:
        return np.zeros(0, np.uint64), grams
    return np.unique(drawn[np.linspace(0, len(drawn) - 1, min(buckets, len(drawn)) + 1).astype(int)[1:-1]]), grams


def _suffixes(shared) -> object:
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, _ = shared.value
        for batch in common.slices(batches, 2, 8 << 20):
            data, offsets = common.flat(batch.column(2))
            ids, chunks = common.ints(batch.column(0), _NULL_ID), common.ints(batch.column(1), 0)
            starts, firsts, lasts = picks(data, offsets)
            row = np.searchsorted(offsets, starts, "right") - 1
            token = tokens(data, starts)[:, 0]
            rest = (common.span_hashes_blockwise(data, starts + 8, starts + GRAM) >> np.uint64(32)).astype(np.uint32)
            at, back, ahead = (starts - offsets[row]).astype(np.uint32), (starts - firsts).astype(np.uint8), (lasts - firsts).astype(np.uint8)
            order, group = multikey_sort([token, rest])
            lead = np.ones(len(order), bool)
            lead[1:] = group[1:] != group[:-1]
            repeated = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
            parts = []
            if repeated.any():  # known to be candidates here already
                own = order[repeated]
                parts += _by_chunk(len(cuts) + 1, "c", chunks[row[own]], ids[row[own]], at[own], back[own], ahead[own])
            sent = order[lead]
            bucket = np.searchsorted(cuts, token[sent], "right")
            mark = repeated[lead].astype(np.uint8)
            bounds = common.group_bounds(bucket)
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j > i:
                    s = sent[i:j]
                    parts.append((int(bucket[i]), -1, "s", common.pack(np.diff(token[s], prepend=np.uint64(0)), rest[s], mark[i:j], ids[row[s]], chunks[row[s]].astype(np.int32), at[s], back[s], ahead[s])))
            yield _rows(parts)

    return suffixes


def _candidates(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: passes on what is known, and finds suffixes that several tasks sent."""
    out, columns = [], []
    for chunk, kind, blob in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["blob"], strict=True):
        if kind == "c":
            out.append((0, chunk, kind, blob.as_py()))
        else:
            columns.append(common.unpack(blob.as_py()))
    if columns:
        token = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
        rest, mark, ids, chunks, at, back, ahead = (np.concatenate([c[i] for c in columns]) for i in range(1, 8))
        order, group = multikey_sort([token, rest])
        tied = np.bincount(group)[group] > 1
        own = order[tied]
        own = own[mark[own] == 0]
        out += _by_chunk(1, "c", chunks[own], ids[own], at[own], back[own], ahead[own])
    return pa.Table.from_batches([_rows(out)])


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text hashes, bytes, offsets, copy number) of a chunk's rows, ordered by id and hash."""
    ids, th = common.ints(table["doc_id"], _NULL_ID), common.ints(table["th"], 0)
    order = np.lexsort((th, ids))
    data, offsets = common.flat(table["text"].take(pa.array(order)))
    ids, th = ids[order], th[order]
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (th[1:] == th[:-1])
    return ids, th, data, offsets, same


def _windows(shared) -> object:
    def windows(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        """Of one chunk: cuts out the windows of candidate suffixes and addresses them to buckets."""
        (cuts, hot), chunk = shared.value, key[0].as_py()
        if texts.num_rows == 0 or found.num_rows == 0:
            return pa.Table.from_batches([_rows([])])
        ids, th, data, offsets, same = _texts(texts)
        blobs = [common.unpack(b.as_py()) for b in found["blob"]]
        doc, at, back, ahead = (np.concatenate([b[i] for b in blobs]).astype(np.int64) for i in range(4))
        # a candidate is tried in every row of its id in the chunk; a second copy of a row is settled at the end
        low, high = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        which, place = common.runs(high - low)
        row = low[which] + place
        start = offsets[row] + at[which] - back[which]
        last = start + ahead[which]
        fits = ~same[row] & (last + LENGTH <= offsets[row + 1]) & (start >= offsets[row])
        row, start, last, back = row[fits], start[fits], last[fits], back[which][fits]
        order = np.lexsort((last, start))
        row, start, last, back = row[order], start[order], last[order], back[order]
        # equal cuts: the first is sent for all, the windows of the others are repetitions already
        print_of = common.span_hashes_blockwise(data, start, last + LENGTH)
        seen: dict[tuple, int] = {}
        lead, known = np.ones(len(row), bool), np.zeros(len(row), bool)
        order, group = multikey_sort([print_of, last - start, back])
        bounds = common.group_bounds(group)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i > 1:
                seen.clear()
                for x in np.sort(order[i:j]):
                    piece = data[start[x] : last[x] + LENGTH].tobytes()
                    if (piece,) in seen:
                        lead[x], known[x] = False, start[x] != seen[(piece,)]
                    else:
                        seen[(piece,)] = start[x]
        parts = []
        if known.any():
            r = row[known]
            parts.append((int(chunk) % (len(cuts) + 1), int(chunk), "w", common.pack(ids[r], th[r], start[known] - offsets[r], last[known] - offsets[r])))
        s = np.flatnonzero(lead)
        if len(hot):
            single = np.isin(common.span_hashes_blockwise(data, start[s] + back[s], start[s] + back[s] + GRAM), hot)
            parts += _singly(int(chunk), len(cuts) + 1, ids, th, data, offsets, start[s[single]], last[s[single]])
            s = s[~single]
        bucket = np.searchsorted(cuts, tokens(data, start[s] + back[s])[:, 0], "right")
        order = np.argsort(bucket, kind="stable")
        s, bucket = s[order], bucket[order]
        bounds = common.group_bounds(bucket)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j > i:
                x = s[i:j]
                size = last[x] + LENGTH - start[x]
                piece, inside = common.runs(size)
                body = data[start[x][piece] + inside]
                parts.append((int(bucket[i]), int(chunk), "d", common.pack(ids[row[x]], th[row[x]], (start[x] - offsets[row[x]]).astype(np.int64), size.astype(np.int32), body)))
        return pa.Table.from_batches([_rows(parts)])

    return windows


def window_prints(data: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """A second hash of the windows at ascending ``spots``, chained from hashes of 32 bytes; a block of the text at a time."""
    out = np.zeros(len(spots), np.uint64)
    at = 0
    while at < len(spots):
        stop = int(np.searchsorted(spots, spots[at] + _SEGMENT, "left"))
        own = spots[at:stop] - spots[at]
        h = _gram_hashes(data[spots[at] : spots[stop - 1] + LENGTH])
        for step in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
            out[at:stop] = common.mix(out[at:stop] + h[own + step])
        at = stop
    return out


def _singly(chunk: int, buckets: int, ids: np.ndarray, th: np.ndarray, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, last: np.ndarray) -> list[tuple[int, int, str, bytes]]:
    """The distinct windows of some cuts of a chunk, dealt by hash; further copies in the chunk are known to be repetitions."""
    piece, inside = common.runs(last - start + 1)
    spot = np.unique(start[piece] + inside)
    if len(spot) == 0:
        return []
    row = np.searchsorted(offsets, spot, "right") - 1
    at = spot - offsets[row]
    first, second = common.span_hashes_blockwise(data, spot, spot + LENGTH), window_prints(data, spot)
    order, group = multikey_sort([first, second])
    again = spot[order] != np.minimum.reduceat(spot[order], common.group_bounds(group)[:-1])[group]
    parts = []
    known = np.sort(order[again])
    if len(known):
        new = np.ones(len(known), bool)
        new[1:] = (spot[known][1:] != spot[known][:-1] + 1) | (row[known][1:] != row[known][:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(known)) - 1
        r = row[known[begin]]
        parts.append((chunk % buckets, chunk, "w", common.pack(ids[r], th[r], at[known[begin]], at[known[end]])))
    own = np.sort(order[~again])
    bucket = (first[own] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    own, bucket = own[by], bucket[by]
    bounds = common.group_bounds(bucket)
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        x = own[i:j]
        parts.append((int(bucket[i]), chunk, "h", common.pack(first[x], second[x], ids[row[x]], th[row[x]], at[x])))
    return parts


def _repeated_prints(columns: list[list[np.ndarray]]) -> list[tuple[int, int, str, bytes]]:
    """Of windows dealt singly: all but the earliest of equal ones."""
    first, second, ids, th, at, chunks = (np.concatenate([c[i] for c in columns]) for i in range(6))
    place = np.empty(len(at), np.int64)
    place[np.lexsort((at, th, ids))] = np.arange(len(at))
    order, group = multikey_sort([first, second])
    least = np.minimum.reduceat(place[order], common.group_bounds(group)[:-1])
    again = np.sort(order[place[order] != least[group]])
    return _by_chunk(1, "w", chunks[again], ids[again], th[again], at[again], at[again]) if len(again) else []


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: the windows that also start earlier."""
    out, columns, single = [], [], []
    for chunk, kind, blob in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["blob"], strict=True):
        if kind == "w":
            out.append((0, chunk, kind, blob.as_py()))
        else:
            got = common.unpack(blob.as_py())
            (single if kind == "h" else columns).append([*got, np.full(len(got[0]), chunk, np.int64)])
    if single:
        out += _repeated_prints(single)
    if columns:
        ids, th, at, size, body, chunks = (np.concatenate([c[i] for c in columns]) for i in range(6))
        base = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        piece, inside = common.runs(size - LENGTH + 1)  # all windows of all cuts
        spot = base[piece] + inside
        leading = tokens(body, spot)[:, 0]
        rest = common.span_hashes_blockwise(body, spot + 8, spot + LENGTH)
        # rank of each cut's document, and with the window's start its place in the corpus
        by = np.lexsort((th, ids))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (ids[by][1:] != ids[by][:-1]) | (th[by][1:] != th[by][:-1])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(fresh)
        place = (rank[piece] << 40) | (at[piece] + inside)
        order, group = multikey_sort([leading, rest])
        bounds = common.group_bounds(group)
        first = np.minimum.reduceat(place[order], bounds[:-1])
        least = np.empty(len(order), np.int64)  # for each group, some window at the earliest place
        earliest = place[order] == first[group]
        least[group[earliest][::-1]] = order[earliest][::-1]
        again = order[~earliest]
        source = least[group[~earliest]]
        # bytes decide: neighbouring windows with neighbouring sources are compared as one stretch
        by = np.argsort(again)
        again, source = again[by], source[by]
        if len(again):
            cut = np.ones(len(again), bool)
            cut[1:] = (again[1:] != again[:-1] + 1) | (source[1:] != source[:-1] + 1) | (piece[again[1:]] != piece[again[:-1]]) | (piece[source[1:]] != piece[source[:-1]])
            begin = np.flatnonzero(cut)
            count = np.diff(np.append(begin, len(again)))
            stretch, inside_stretch = common.runs(count + LENGTH - 1)
            equal = body[spot[again[begin]][stretch] + inside_stretch] == body[spot[source[begin]][stretch] + inside_stretch]
            sound = np.logical_and.reduceat(equal, np.cumsum(np.append(0, count + LENGTH - 1))[:-1])
            kept = sound[np.cumsum(cut) - 1]
            doubtful = np.isin(np.arange(len(order)), np.concatenate([again[~kept], source[~kept]]))
            again = np.union1d(again[kept], _by_bytes(body, spot, place, group, order, doubtful)) if doubtful.any() else again[kept]
        if len(again):
            p = piece[again]
            start = at[p] + inside[again]
            cut = np.ones(len(again), bool)
            cut[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(again)) - 1
            out += _by_chunk(1, "w", chunks[p[begin]], ids[p[begin]], th[p[begin]], start[begin], start[end])
    return pa.Table.from_batches([_rows(out)])


def _by_bytes(body, spot, place, group, order, doubtful) -> np.ndarray:
    """Repeated windows of the groups that hold a doubtful one, by their bytes alone."""
    bad = np.isin(group, np.unique(group[doubtful[order]]))
    first: dict[bytes, int] = {}
    own = order[bad]
    text = {int(w): body[spot[w] : spot[w] + LENGTH].tobytes() for w in own}
    for w in own:
        first[text[int(w)]] = min(first.get(text[int(w)], 1 << 62), int(place[w]))
    return np.array([w for w in own if place[w] != first[text[int(w)]]], np.int64)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(with_text: bool) -> object:
    def apply(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        """Of one chunk: removes the covered bytes of each row."""
        ids, th, data, offsets, same = _texts(texts)
        edges = np.zeros(len(data) + 1, np.int64)
        if found.num_rows and len(ids):
            blobs = [common.unpack(b.as_py()) for b in found["blob"]]
            doc, hashed, first, last = (np.concatenate([b[i] for b in blobs]) for i in range(4))
            row = _find(ids, th, doc, hashed)
            np.add.at(edges, offsets[row] + first, 1)
            np.add.at(edges, offsets[row] + last + LENGTH, -1)
        covered = np.cumsum(edges[:-1]) > 0
        for r in np.flatnonzero(same & (np.diff(offsets) >= LENGTH)):
            covered[offsets[r] : offsets[r + 1]] = True
        columns: list[list] = [[], [], [], [], []]
        for r in range(len(ids)):
            own = covered[offsets[r] : offsets[r + 1]]
            left = data[offsets[r] : offsets[r + 1]][~own].tobytes()
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            for column, value in zip(columns, (None if ids[r] == _NULL_ID else int(ids[r]), len(own), int(own.sum()), spans, left if with_text else hashlib.sha256(left).hexdigest()), strict=True):
                column.append(value)
        last = ("text", pa.string()) if with_text else ("kept_sha256", pa.string())
        if with_text:  # bytes may be cut inside a character; such halves are dropped
            columns[4] = [b.decode(errors="ignore") for b in columns[4]]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], last[1])], names=["doc_id", "n_bytes", "n_removed", "n_spans", last[0]])

    return apply


def _find(ids: np.ndarray, th: np.ndarray, doc: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """First row of each (doc, hash); rows are ordered by both, and all wanted ones are there."""
    keys = np.empty(len(ids), [("i", np.int64), ("h", np.int64)])
    keys["i"], keys["h"] = ids, th
    wanted = np.empty(len(doc), keys.dtype)
    wanted["i"], wanted["h"] = doc, hashed
    return np.searchsorted(keys, wanted, "left")


# --- the operator ------------------------------------------------------------------------------------------------------------------


def _chunked(docs: DataFrame, chunks: int) -> DataFrame:
    doc_id: Column = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    # with the text, so that null or repeated ids do not fill one chunk; rows equal in both stay together
    chunk = F.pmod(F.xxhash64(F.lit(1), doc_id, text), F.lit(chunks)).cast("int")
    return docs.select(doc_id.alias("doc_id"), chunk.alias("chunk"), text.alias("text"))


def _windows_of(docs: DataFrame, hot_contexts: int) -> tuple[DataFrame, DataFrame]:
    """(texts by chunk, windows of repeated suffixes by bucket)."""
    spark = docs.sparkSession
    n_bytes = common.text_bytes(docs)
    chunks = common.chunk_count(spark, n_bytes, 12 << 20)
    buckets = max(4 * common.parallelism(spark), math.ceil(n_bytes / (6 << 20)))
    shared = spark.sparkContext.broadcast(splitters(docs, buckets, hot_contexts))
    rows = _chunked(docs, chunks)
    texts = rows.select("chunk", "doc_id", F.xxhash64("text").alias("th"), "text")

    suffixes = rows.select("doc_id", "chunk", "text").mapInArrow(_suffixes(shared), _KEYED)
    candidates = suffixes.groupBy("bucket").applyInArrow(_candidates, _KEYED).select("chunk", "blob")
    return texts, texts.groupBy("chunk").cogroup(candidates.groupBy("chunk")).applyInArrow(_windows(shared), _KEYED)


def _run(docs: DataFrame, with_text: bool, schema: str, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    texts, windows = _windows_of(docs, hot_contexts)
    repeated = windows.groupBy("bucket").applyInArrow(_repeated, _KEYED).select("chunk", "blob")
    return texts.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_apply(with_text), schema)


def report(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per document: its bytes, those removed, their maximal runs, and a digest of what is left."""
    return _run(docs, False, _RESULT, hot_contexts)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document with the text that is left (``doc_id``, counts, ``text``)."""
    return _run(docs, True, "doc_id long, n_bytes long, n_removed long, n_spans long, text string")
