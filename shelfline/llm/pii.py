r"""Personal data: patterns for direct identifiers, information theory for what gives them away.

Direct identifiers (email, ip, card, phone) are found by pattern, leftmost and not overlapping per
kind; a match that fails its test is dropped. They are the protected entities. The words
around a mention are then judged by how much they reveal of it, estimated on the whole corpus:

    PMI(entity; term) = log2 p(term, entity) / (p(term) p(entity)),   IC(entity) = -log2 p(entity),

with p(term) from all words of all texts and joint counts from the mentions' contexts (``AROUND``
words to either side). All counts are of occurrences, copies included: a joint one is a word that stands
near some mention of the entity. Disclosure is PMI / IC: 1 if a term occurs with the entity only, so that
reading it is reading the entity. Terms at or above ``THRESHOLD`` are generalised or removed: a word's classes are the words
that share its first ``PREFIXES`` bytes (a full date to its year, a name to its beginning), whose own disclosure is
estimated in the same way, over all words of the class. The narrowest class below the threshold replaces the
term, and a term without one is taken out. At least ``SUPPORT`` different contexts must support a pair;
there, and only there, equal contexts (copies) count as one. Where nothing is protected, nothing is touched.

Pairs come from the contexts of mentions, but a term that reveals an entity does so wherever it stands:
a second pass over all texts spans every occurrence outside the direct identifiers. Words that meet an
entity only outside all of its contexts are not paired with it.

Positions are code points. Null and empty texts hold nothing. Rows are known by id and text:
equal rows get equal spans, a null id is an id. An empty table gives an empty result.
Other columns are not read (``sanitise`` passes them on).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import common
from shelfline.session import stash

KINDS = ("email", "ip", "card", "phone", "term")
AROUND = 8
SUPPORT = 2
THRESHOLD = 0.9
PREFIXES = (4, 2)  # bytes of a word that its classes keep, the narrowest first
FILTER_BITS = 1 << 23  # of the fixed-size filter that thins word counts before their shuffle

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where its digits start; nothing is tried again inside a run, so long runs take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of local part, @ and dotted domain, each found from its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def find(text: str) -> list[Span]:
    """The direct identifiers of one text, ordered by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def may_hold(data: bytes) -> bool:
    """False only if no pattern can match; a few fast byte scans."""
    return b"@" in data or len(data.translate(None, _DIGITS)) >= 4


def entity(text: str, span: Span) -> str:
    """The identity of a mention, whatever its spelling."""
    kind, a, b = span
    value = text[a:b]
    return f"{kind}:{value.translate(_LOWER) if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def apart(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a stretch [start, end) touches none of the spans."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(start: int, end: int) -> bool:
        at = bisect_right(ends, start)
        return at == len(ends) or starts[at] >= end

    return free


def _before(text: str, a: int, free: Callable[[int, int], bool]) -> list[re.Match]:
    """The ``AROUND`` free words before ``a``, whole ones: the stretch that is read grows until it holds them."""
    size = 400
    while True:
        low = max(0, a - size)
        found = list(WORD.finditer(text, low, a))
        if low and found and found[0].start() == low:  # may be a fragment
            del found[0]
        if found and found[-1].end() == a and WORD.match(text, a):  # goes on inside the mention
            del found[-1]
        found = [m for m in found if free(m.start(), m.end())]
        if low == 0 or len(found) >= AROUND:
            return found[-AROUND:]
        size *= 2


def _after(text: str, b: int, free: Callable[[int, int], bool]) -> list[re.Match]:
    size = 400
    while True:
        high = min(len(text), b + size)
        found = list(WORD.finditer(text, b, high))
        if high < len(text) and found and found[-1].end() == high:
            del found[-1]
        if found and found[0].start() == b and WORD.match(text, b - 1):
            del found[0]
        found = [m for m in found if free(m.start(), m.end())]
        if high == len(text) or len(found) >= AROUND:
            return found[:AROUND]
        size *= 2


def contexts(text: str, spans: list[Span]) -> list[tuple[int, ...]]:
    """(entity, context, term, start, end, digits only, new, first, class for each of ``PREFIXES``) of the words around each mention; the first three are hashes.

    ``new`` is 1 once for a word however many mentions of the entity are near, ``first`` is 1 once for a mention.
    """
    out, known = [], set()
    free = apart(spans)
    for span in spans:
        _, a, b = span
        near = _before(text, a, free) + _after(text, b, free)
        if not near:
            continue
        words = [m[0].translate(_LOWER) for m in near]
        column = pa.array([w.encode() for w in words], pa.large_binary())
        hashes, _ = common.words(*common.flat(column), common.byte_classes("alnum"))
        classed = [common.words(*common.flat(column), common.byte_classes("alnum"), p)[0].view(np.int64).tolist() for p in PREFIXES]
        name, context = (int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in (entity(text, span), " ".join(words)))
        new = [int((name, m.start()) not in known) for m in near]
        known.update((name, m.start()) for m in near)
        out += [(name, context, int(h), m.start(), m.end(), int(w.isdecimal()), n, int(m is near[0]), *c) for h, m, w, n, *c in zip(hashes.view(np.int64), near, words, new, *classed, strict=True)]
    return out


_SPAN = "struct<start:int,kind:int,finish:int>"
_FOUND = f"doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{_SPAN}>, near array<struct<entity:long,context:long,term:long,new:int,first:int," + ",".join(f"p{p}:long" for p in PREFIXES) + ">>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("finish", pa.int32())]))
    kinds = [("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64()), ("new", pa.int32()), ("first", pa.int32()), *((f"p{p}", pa.int64()) for p in PREFIXES)]
    near = pa.list_(pa.struct(kinds))
    for batch in common.slices(batches, 2):
        counts, hashes, bases, around = [[], [], [], []], [], [], []
        for data in batch.column(2).cast(pa.binary()).to_pylist():
            text = data.decode() if data and may_hold(data) else ""
            base = find(text) if text else []
            for kind, count in zip(KINDS, counts, strict=False):
                count.append(sum(k == kind for k, _, _ in base))
            hashes.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            bases.append([{"start": a, "kind": KINDS.index(k), "finish": b} for k, a, b in base])
            around.append([dict(zip([k for k, _ in kinds], (*x[:3], *x[6:]), strict=True)) for x in contexts(text, base)] if base else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(bases, span), pa.array(around, near)], names=names)


def _inside(allowed: np.ndarray, signed: np.ndarray) -> np.ndarray:
    bit = np.mod(signed, FILTER_BITS)
    return (allowed[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counter(shared, first: int | None) -> object:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, classes, total = shared.value, common.byte_classes("alnum"), 0
        for batch in common.slices(batches, 0, 8 << 20):
            hashes, _ = common.words(*common.flat(batch.column(0)), classes, first)
            total += len(hashes)
            signed = hashes.view(np.int64)
            terms, n = np.unique(signed[_inside(allowed, signed)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["term", "n"])

    return counted


def _bitmap(terms: DataFrame) -> np.ndarray:
    """A bitmap of ``terms``. It has a fixed size whatever their number, so it may be broadcast; a full one only thins less."""
    place = F.pmod(F.col("term"), F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = terms.select(F.floor(place / 64).alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        bitmap[row.slot] = row.bits
    return bitmap.view(np.uint64)


def term_counts(docs: DataFrame, terms: DataFrame, first: int | None = None) -> DataFrame:
    """Occurrences ``n`` of each of ``terms`` among all words; the row of a null term counts all words. With ``first``, terms are classes of words.

    Tasks count only words that pass a bitmap of the wanted terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    return docs.select("text").mapInArrow(_counter(shared, first), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _spotter(shared) -> object:
    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, classes = shared.value, common.byte_classes("alnum")
        for batch in common.slices(batches, 2, 2 << 20):
            hashes, at = common.words(*common.flat(batch.column(2)), classes)
            signed = hashes.view(np.int64)
            hits = np.flatnonzero(_inside(allowed, signed))
            rows = np.searchsorted(at, hits, "right") - 1
            bounds = common.group_bounds(rows)
            out: list[list] = [[], [], [], [], []]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                r, wanted = int(rows[i]), iter(hits[i:j].tolist())
                text = batch.column(2)[r].as_py()
                free = apart(find(text) if may_hold(text.encode()) else [])
                word = next(wanted)
                for k, m in enumerate(WORD.finditer(text), int(at[r])):
                    if k < word:
                        continue
                    if free(m.start(), m.end()):
                        for column, value in zip(out, (r, int(signed[k]), m.start(), m.end(), int(m[0].isdecimal())), strict=True):
                            column.append(value)
                    if (word := next(wanted, None)) is None:
                        break
            own = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(out[1], pa.int64()), *(pa.array(c, pa.int32()) for c in out[2:])], names=["doc_id", "th", "term", "start", "finish", "digits"])

    return spotted


def occurrences(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """(doc_id, th, start, finish, digits, disclosure, keep) of every word of the texts that is a strong term."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(strong))
    words = rows.select("doc_id", "th", "text").mapInArrow(_spotter(shared), "doc_id long, th long, term long, start int, finish int, digits int")
    return words.join(strong, "term").drop("term")


def supported(near: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, both): occurrences of the term near the entity, of the pairs seen in at least ``support`` different contexts."""
    seen = near.groupBy("entity", "term", "context").agg(F.sum("new").alias("new"))
    pairs = seen.groupBy("entity", "term").agg(F.sum("new").alias("both"), F.count("*").alias("contexts"))
    return pairs.where(F.col("contexts") >= support).drop("contexts")


def disclosures(joint: DataFrame, near: DataFrame, counts: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the supported pairs."""
    mentions = near.groupBy("entity").agg(F.sum("first").alias("mentions"))
    total = counts.where("term is null").agg(F.max("n")).scalar()
    known = counts.where("term is not null")
    pairs = joint.join(known, "term").join(mentions, "entity").withColumn("total", total)
    pmi = F.log2(F.col("both") / F.greatest("n", "both") * (F.col("total") / F.col("mentions")))
    content = F.log2(F.greatest(F.col("total") / F.col("mentions"), F.lit(2.0)))
    return pairs.select("entity", "term", (pmi / content).alias("disclosure"))


def generalised(docs: DataFrame, near: DataFrame, strong: DataFrame, support: int, threshold: float) -> DataFrame:
    """``strong`` with ``keep``: the first bytes of the term that may stay, those of its narrowest class below the threshold; 0 if none is."""
    out = strong.join(near.select("term", *(f"p{p}" for p in PREFIXES)).distinct(), "term")
    keep = F.lit(0)
    for p in reversed(PREFIXES):
        own = near.select("entity", "context", F.col(f"p{p}").alias("term"), "new", "first")
        joint = stash(supported(own, support), "pii-class-joint")
        counts = stash(term_counts(docs, joint.select("term").distinct(), p), "pii-class-counts")
        telling = disclosures(joint, own, counts).where(F.col("disclosure") >= threshold).select(F.col("term").alias(f"p{p}"), F.lit(True).alias(f"tells{p}")).distinct()
        out = out.join(telling, f"p{p}", "left")
        keep = F.when(F.col(f"tells{p}").isNull(), F.lit(p)).otherwise(keep)
    return out.select("term", "disclosure", keep.alias("keep"))


def judged(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, levels: bool = False) -> DataFrame:
    """One row per document row: counts, base spans, and ``terms``, the spans that reveal an entity with their disclosure.

    With ``levels``, ``keep`` tells how much of each term may stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = stash(rows.mapInArrow(_scan, _FOUND), "pii-found")
    near = found.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*")
    joint = stash(supported(near, support), "pii-joint")
    counts = stash(term_counts(docs, joint.select("term").distinct()), "pii-counts")
    strong = disclosures(joint, near, counts).where(F.col("disclosure") >= threshold)
    strong = stash(strong.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-strong")
    strong = stash(generalised(docs, near, strong, support, threshold), "pii-levels") if levels else strong.withColumn("keep", F.lit(0))
    own = occurrences(rows, strong).distinct()  # equal rows have equal words
    own = own.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "finish", "digits", "disclosure", "keep"))).alias("terms"))
    own = own.withColumnRenamed("doc_id", "own_id").withColumnRenamed("th", "own_th")
    same = found["doc_id"].eqNullSafe(own["own_id"]) & (found["th"] == own["own_th"])
    return found.drop("near").join(own, same, "left").drop("own_id", "own_th")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of direct identifiers, and all spans as ``kind:start:end``."""
    rows = judged(docs)
    term = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,finish:int,digits:int,disclosure:double,keep:int>>")), lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), t["finish"].alias("finish")))
    every = F.array_sort(F.concat("base", term))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["finish"].cast("string")))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"))


def replaced(text: str, base: list[Span], terms: list[tuple[int, int, int, float, int]]) -> str:
    """The text with identifiers masked and revealing terms generalised (to their first letters and a star) or removed."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    marks += [(a, b, text[a:b].encode()[:keep].decode(errors="ignore") + "*" if keep else "") for a, b, _, _, keep in terms]
    out, at = [], 0
    for a, b, new in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            spans = [(KINDS[s["kind"]], s["start"], s["finish"]) for s in base or []]
            texts.append(text if text is None else replaced(text, spans, [tuple(t.values()) for t in terms or []]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with all their columns and sanitised ``text``."""
    spans = judged(docs, levels=True).select(F.col("doc_id").alias("j_id"), F.col("th").alias("j_th"), "base", "terms").where((F.size("base") > 0) | F.col("terms").isNotNull()).distinct()
    state = docs.select(common.whole_row([c for c in docs.columns if c != "text"]), "text", F.xxhash64("text").alias("th"))
    joined = state.join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("j_id")) & (F.col("th") == F.col("j_th")), "left").select("row", "text", "base", "terms")
    done = joined.mapInArrow(_apply, common.schema_of(joined, "row", "text"))
    return done.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
