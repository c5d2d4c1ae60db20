import re
from itertools import permutations

import numpy as np
import pytest

from shelfline.llm import filter_audit as fa

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [LONG, LONG, LONG + " $", "AB cd", "", None, "a " * 300, "a " * 300, LONG.upper(), "é" * 40, "x\x1fy z|", " \t\r\n\x0b\x0c", LONG + " é", "a b c", LONG]
LANGS = ["en", "de", None, "", "en"]


def documents():
    rows = [(k if k != 4 else None, text, LANGS[k % len(LANGS)]) for k, text in enumerate(TEXTS * 3)]
    return rows + [(0, LONG, "en"), (0, LONG, "de"), (None, LONG, "en"), (-5, "a " * 300, "de")]


def failing(rows):
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        checks = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier]
        out.append({letter for letter, bad in zip("ABCDE", checks, strict=True) if bad})
    return out


def brute(rows, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            old = marks.get(doc_id, (False, False))
            marks[doc_id] = (old[0] or quality == 1, old[1] or toxic == 1)
    fails, out = failing(rows), []
    for part in {lang or "" for _, _, lang in rows}:
        own = [(f, marks.get(d, (False, False))) for (d, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        told, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before, mine = set(order[: step - 1]), [(f, m) for f, m in own if letter in f]
                here = [(f, m) for f, m in mine if not f & before]
                total[letter] += len(here)
                kept = sum(not f & set(order[:step]) for f, _ in own)
                told.append((part, "".join(order), step, kept, len(here), len(mine) - len(here), sum(f == {letter} for f, _ in own), sum(m[0] for _, m in here), sum(m[1] for _, m in here), letter))
        out += [(*t[:-1], total[t[-1]]) for t in told]
    return sorted(out, key=str)


LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (3, 1, None), (7, 0, 0), (None, 1, 1), (99, 1, 1), (16, 1, 0)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, fails string, good int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    rows = documents()
    docs, labels = frames(spark, rows, LABELS)
    got = sorted((tuple(r) for r in fa.report(docs.repartition(3), labels).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows, LABELS)
    assert len(got) == 3 * 600


def test_verdicts(spark):
    rows = documents()
    docs, _ = frames(spark, rows, LABELS)
    got = sorted((str(r.doc_id), r.part, r.fails) for r in fa.verdicts(docs).collect())
    assert got == sorted((str(d), lang or "", sum(1 << "ABCDE".index(x) for x in f)) for (d, _, lang), f in zip(rows, failing(rows), strict=True))


def test_empty_tables(spark):
    docs, labels = frames(spark, documents(), LABELS)
    assert fa.report(docs.limit(0), labels).count() == 0
    assert fa.report(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_truth_words():
    table = fa.truth_words()
    for fails in range(32):
        assert [int(table[fails]) >> s & 1 for s in range(32)] == [int(not fails & s) for s in range(32)]


@pytest.mark.parametrize("sizes", [[1], [0, 5, 0, 3], [1000, 1, 2, 77, 0], [3] * 50, [70_000]])
def test_popcounts(sizes):
    draw = np.random.default_rng(len(sizes))
    values = draw.integers(0, 1 << 32, sum(sizes), dtype=np.uint64).astype(np.uint32)
    got = fa.positional_popcounts(values, np.array(sizes))
    ends = np.cumsum(sizes)
    for g, (end, size) in enumerate(zip(ends, sizes, strict=True)):
        own = values[end - size : end]
        assert got[g].tolist() == [int((own >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_many_parts_are_passed_on(spark):
    """More parts than a task holds; each still gets all of its documents."""
    rows = [(i, "a b", f"p{i % 5000}") for i in range(20_000)]
    frame = spark.createDataFrame([(lang, i % 32, i % 2 == 0, False) for i, _, lang in rows], "part string, fails int, good boolean, toxic boolean").coalesce(1)
    got = fa.survivors(frame).where("subset = 0").collect()
    assert len(got) == 5000 and {r.n for r in got} == {4}


def test_hot_text_and_missing_ids(spark):
    """A third of the rows share one text and a third have no id."""
    rows = [(i, "same", "en") for i in range(300)] + [(None, f"t{i}", "en") for i in range(300)] + [(1000 + i, f"u{i}", "en") for i in range(300)]
    docs, labels = frames(spark, rows, LABELS)
    got = fa.report(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (got.removed, got.kept) == (299, 601)
