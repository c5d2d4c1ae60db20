r"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secrets, and so is every layer that can be
unwrapped from it: percent-encoding, backslash and HTML Unicode escapes, base64 (both
alphabets, wrapped over lines, and behind a path or name, so that it starts anywhere in its run) and
gzip, zlib or raw deflate data in base64, percent or ``\x`` escapes, with all members. Decoded bytes are layers as
well: they are read as UTF-8, else byte by byte, without the NULs of UTF-16, and what they
inflate to goes back to the worklist. A layer keeps, for each of its characters, the span of
the original text that it came from, so a match deep inside maps back to the original; what comes out of
compressed data maps to the whole of it. Layers wait in a worklist until none is left; a layer
or byte string seen before at its place is not taken up again, so archives that hold each other end.

Escapes are peeled one by one ``DEPTH`` deep, and all at once from there on: a text nested n deep takes time in proportion to n.
Compressed data are inflated in windows of ``WINDOW`` bytes that overlap by ``OVERLAP``, each scanned to its
end before the next is made, so no size is left out; only a secret or inner layer longer than the overlap can be cut at a
window's edge.

Kinds: ``assign`` (a named value of 12 or more characters), ``access`` (18 or more) and
``hex`` (16 or more). Base spans are those of the text itself, leftmost and not
overlapping per kind; unwrapped layers only add spans. All positions are code points.

Null and empty texts have no spans. Rows are independent, so repeated rows give repeated
results, and an empty table gives none. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # the hex matches that do not fail; runs are maximal either way
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+)")
PACKED = re.compile(r"H4sI|(?<=[/_+-])e[AFJN]")  # how gzip and zlib data start in base64
BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}){8,}|(?:\\x[0-9A-Fa-f]{2}){8,}")
SPECIAL = re.compile(r"[%\\&]")
_PEEL = {
    "%": re.compile(r"([0-9A-Fa-f]{2})"),
    "\\": re.compile(r"u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})"),
    "&": re.compile(r"#x([0-9A-Fa-f]{1,6});|#(?=[0-9]{1,7};)"),
}
_NUMBER = re.compile(r"([0-9]{1,7});")
DEPTH = 3
WINDOW = 16 << 20
OVERLAP = 1 << 20
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUNS = bytes(c if chr(c).isalnum() and c < 128 or c in b"+/_-" else 32 for c in range(256))

Span = tuple[str, int, int]


def find(text: str) -> list[Span]:
    """The secrets that stand in one text as it is."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]


class Layer:
    """A text and, for each character, where it came from: ``starts`` and ``ends`` in the original, or one span for all."""

    def __init__(self, text: str, starts: np.ndarray | int | None = None, ends: np.ndarray | int | None = None, depth: int = 0):
        self.text, self.depth = text, depth
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def picked(self, first: np.ndarray, last: np.ndarray) -> tuple:
        """Starts and ends of characters that come from the characters ``first`` to ``last`` (included) of this layer."""
        return (self.starts, self.ends) if isinstance(self.starts, int) else (self.starts[first], self.ends[last])

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """This layer with the given spans replaced; new characters come from their whole span."""
        text, starts, ends, at = [], [], [], 0
        flat = isinstance(self.starts, int)
        for a, b, new in parts:
            text += [self.text[at:a], new]
            if not flat:
                low, high = self.span(a, b)
                starts += [self.starts[at:a], np.full(len(new), low)]
                ends += [self.ends[at:a], np.full(len(new), high)]
            at = b
        text.append(self.text[at:])
        if flat:
            return Layer("".join(text), self.starts, self.ends, self.depth + 1)
        return Layer("".join(text), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]), self.depth + 1)


class Data:
    """Bytes of a layer, with the span of each byte or one for all."""

    def __init__(self, raw: bytes, starts: np.ndarray | int, ends: np.ndarray | int, depth: int):
        self.raw, self.starts, self.ends, self.depth = raw, starts, ends, depth

    def whole(self) -> tuple[int, int]:
        return (self.starts, self.ends) if isinstance(self.starts, int) else (int(self.starts.min()), int(self.ends.max()))

    def read(self) -> Layer | None:
        """The text of these bytes: UTF-8, or else byte by byte; NULs, as UTF-16 has them, are left out. None if it can hold nothing."""
        raw, starts, ends = self.raw, self.starts, self.ends
        flat = isinstance(starts, int)
        if b"\0" in raw:
            if not flat:
                kept = np.frombuffer(raw, np.uint8) != 0
                starts, ends = starts[kept], ends[kept]
            raw = raw.replace(b"\0", b"")
        if not suspicious(raw):
            return None
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return Layer(raw.decode("latin-1"), starts, ends, self.depth)
        if not flat:
            first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            starts, ends = starts[first], ends[np.append(first[1:], len(raw)) - 1]
        return Layer(text, starts, ends, self.depth)


def unpercent(layer: Layer) -> Layer | None:
    parts = []
    for m in PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:  # one character at a time, so that positions stay fine
            at = m.start()
            for char in raw.decode():
                size = 3 * len(char.encode())
                parts.append((at, at + size, char))
                at += size
        except UnicodeDecodeError:
            parts += [(m.start() + 3 * i, m.start() + 3 * i + 3, chr(b)) for i, b in enumerate(raw) if b < 128]
    return layer.replaced(parts) if parts else None


def unescape(layer: Layer) -> Layer | None:
    parts = []
    for m in ESCAPE.finditer(layer.text):
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code)))
    return layer.replaced(parts) if parts else None


def peeled(layer: Layer) -> Layer | None:
    """All escapes decoded to the last, also those that decoding makes, in one pass."""
    text, parts, at = layer.text, [], 0
    while m := SPECIAL.search(text, at):
        char, start, at = m[0], m.start(), m.end()
        while char in _PEEL and (m := _PEEL[char].match(text, at)):
            code = next((g for g in m.groups() if g), None)
            if code is None:  # a decimal HTML escape
                m = _NUMBER.match(text, m.end())
                code = int(m[1])
            else:
                code = int(code, 16)
            if code >= 0x110000 or 0xD800 <= code < 0xE000:
                break
            char, at = chr(code), m.end()
        if at > start + 1:
            parts.append((start, at, char))
    return layer.replaced(parts) if parts else None


def compressed(raw: bytes) -> int | None:
    """The window bits that zlib needs for these bytes; None if they are not compressed."""
    if raw[:3] == b"\x1f\x8b\x08" or raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return 47
    if raw and raw[0] & 7 in (2, 3, 4, 5) and not raw[:64].isascii():  # raw deflate has no header: its start must give text
        try:
            start = zlib.decompressobj(-15).decompress(raw[:512], 512)
        except zlib.error:
            return None
        if len(start) >= 16 and sum(32 <= b < 127 or b in b"\t\n\r" for b in start) >= 0.95 * len(start):
            return -15
    return None


def inflated(raw: bytes, bits: int, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[bytes]:
    """Windows over all members of compressed data, as far as they can be read."""
    held, fresh = bytearray(), 0
    while raw:
        engine, wait = zlib.decompressobj(bits), raw
        while not engine.eof:
            try:
                out = engine.decompress(wait, window)
            except zlib.error:
                break
            wait = engine.unconsumed_tail
            held += out
            fresh += len(out)
            if len(held) >= window:
                yield bytes(held)
                del held[: max(0, len(held) - min(overlap, window // 2))]
                fresh = 0
            if not out and not wait:
                break
        following = engine.unused_data if engine.eof else b""
        raw = following if compressed(following) == bits else b""
    if fresh:
        yield bytes(held)


def base64_runs(layer: Layer) -> Iterator[tuple[str, np.ndarray, int]]:
    """(characters, their places, end with padding) of every base64 run, and of runs that go on over line breaks until a short line."""
    end = 0
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run)), m.end()
        lines, places, at = [run], [np.arange(m.start(), m.start() + len(run))], m.end()
        while m.start() >= end and len(lines[-1]) >= 16 and (line := NEXT_LINE.match(layer.text, at)):
            lines.append(line[1])
            places.append(np.arange(line.start(1), line.end(1)))
            at = line.end()
        if len(lines) > 1:
            yield "".join(lines), np.concatenate(places), at
            end = at


def unbase64(layer: Layer) -> Iterator[Data]:
    """The bytes of each base64 run that may hold a secret or another layer, from wherever the data may start in it."""
    for run, places, end in base64_runs(layer):
        starts = [0, 1, 2, 3, *{m.start() for m in PACKED.finditer(run)} - {0, 1, 2, 3}]
        for at in starts:
            own = run[at : len(run) - ((len(run) - at) % 4 == 1)]
            try:
                raw = base64.b64decode(own.replace("-", "+").replace("_", "/") + "=" * (-len(own) % 4))
            except (binascii.Error, ValueError):
                continue
            if not compressed(raw) and not suspicious(raw.replace(b"\0", b"")):
                continue
            byte = np.arange(len(raw))
            first = at + byte // 3 * 4 + byte % 3
            last = places[first + 1]
            last[-1] = end - 1
            yield Data(raw, *layer.picked(places[first], last), layer.depth + 1)


def unbytes(layer: Layer) -> Iterator[Data]:
    """The bytes of runs of percent or backslash escapes that are compressed data."""
    for m in BYTES.finditer(layer.text):
        raw = bytes.fromhex(re.sub(r"%|\\x", "", m[0]))
        if compressed(raw):
            yield Data(raw, *layer.span(m.start(), m.end()), layer.depth + 1)


def scan(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each ordered by start and kind."""
    base = find(text)
    found, seen = set(base), {hashlib.sha256(text.encode()).digest() + bytes(16)}
    work: list[Layer | Data | Iterator[Data]] = [Layer(text)]

    def new(content: bytes, low: int, high: int) -> bool:
        key = hashlib.sha256(content).digest() + low.to_bytes(8, "big") + high.to_bytes(8, "big")
        if key in seen:
            return False
        seen.add(key)
        return True

    while work:
        item = work.pop()
        if isinstance(item, Layer):
            if item.depth:
                found.update((kind, *item.span(a, b)) for kind, a, b in find(item.text))
            escapes = [unpercent(item), unescape(item)] if item.depth < DEPTH else [peeled(item)]
            for x in escapes:
                if x is not None and x.text and new(x.text.encode(errors="surrogatepass"), *x.span(0, len(x.text))):
                    work.append(x)
            work += unbytes(item)
            work += unbase64(item)
        elif isinstance(item, Data):
            bits = compressed(item.raw)
            if bits and new(item.raw, *item.whole()):
                low, high, depth = *item.whole(), item.depth + 1
                work.append(Data(part, low, high, depth) for part in inflated(item.raw, bits, window, overlap))
            layer = item.read()
            if layer is not None and layer.text and new(layer.text.encode(errors="surrogatepass"), *layer.span(0, len(layer.text))):
                work.append(layer)
        elif (part := next(item, None)) is not None:  # the windows of compressed data, one after the other
            work += [item, part]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order)


def suspicious(data: bytes) -> bool:
    """False only if neither the text nor any layer in it can hold a secret; a few fast byte scans."""
    if b"AKIA" in data or b"%" in data or b"\\" in data or b"&#" in data:
        return True
    low = data.lower()
    return any(w in low for w in _WORDS) or max(map(len, data.translate(_RUNS).split()), default=0) >= 16


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mask``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a], mask]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in common.slices(batches, 1):
        counts, hashes, spans = [[], [], []], [], []
        for data in batch.column(1).cast(pa.binary()).to_pylist():
            base, every = scan(data.decode()) if data and suspicious(data) else ([], [])
            for kind, count in zip(KINDS, counts, strict=False):
                count.append(sum(k == kind for k, _, _ in base))
            hashes.append(hashlib.sha256(listed(base).encode()).hexdigest() if base else empty)
            spans.append(listed(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans as ``kind:start:end``."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_report, schema)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1):
        texts = []
        for data in batch.column(1).cast(pa.binary()).to_pylist():
            text = None if data is None else data.decode()
            texts.append(redact(text, scan(text)[1]) if data and suspicious(data) else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def clean(docs: DataFrame) -> DataFrame:
    """All documents with their columns; secrets are masked in ``text``, and ``n_chars``, if there, follows."""
    state = docs.select(common.whole_row([c for c in docs.columns if c != "text"]), "text")
    done = state.mapInArrow(_redacted, common.schema_of(state, "row", "text"))
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    own = {"text": F.col("text"), "n_chars": F.when(F.col("row.n_chars").isNotNull(), length) if "n_chars" in docs.columns else None}
    return done.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))
