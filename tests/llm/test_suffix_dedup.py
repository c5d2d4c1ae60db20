import hashlib
import random

import numpy as np
import pytest

from shelfline.llm import suffix_dedup

SCHEMA = "doc_id long, text string, chunk int, blob string"


def brute(rows):
    """Every 100-byte string of every text, in order of id, hash and start."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in suffix_dedup.report(df).collect()), key=str)


def prose(draw, n):
    return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "Größe", "日本", "zeta"]) + str(draw.randrange(99)) for _ in range(n))


def test_matches_brute_force(spark):
    draw = random.Random(1)
    passage, other = prose(draw, 40), prose(draw, 30)
    rows = []
    for i in range(60):
        parts = [prose(draw, draw.randrange(1, 30))]
        if i % 3 == 0:  # a third of all rows share a passage
            parts.append(passage)
        if i % 4 == 0:
            parts += [other, prose(draw, 5), other]
        rows.append((i, " ".join(parts)))
    rows += [(70, "ab" * 400), (71, "a" * 1000), (72, "a" * 99), (73, "b" * 100 + "b" * 100), (74, None), (75, "")]
    rows += [(80, rows[0][1]), (81, rows[0][1][:-1] + "!")]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_lose_their_copies(spark):
    text = "".join(random.Random(2).choices("abcdef ", k=250))
    got = run(spark, [(5, text), (5, text), (5, "short"), (5, "short"), (None, text)])
    assert [r[2] for r in got if r[1] == 250] == [250, 250, 0] or sorted(r[2] for r in got if r[1] == 250) == [0, 250, 250]
    assert [r[2] for r in got if r[0] is None] == [0]  # a null id comes before all others
    assert all(r[2] == 0 for r in got if r[1] == 5)


def lines_in_a_third(n):
    """Texts of which a third hold one line of 62 bytes, and some a passage of 130, between other words."""
    draw = random.Random(9)
    line, passage = "".join(draw.choices("abcdefgh ", k=62)), "".join(draw.choices("abcdefgh ", k=130))
    word = lambda: "".join(draw.choices("ijklmnopq ", k=draw.randrange(40, 200)))
    rows = [(i, word() + (line if i % 3 == 0 else word()) + word() + (passage if i % 10 == 1 else "")) for i in range(n)]
    return rows + [(n + i, rows[3 * i][1]) for i in range(5)] + [(None, rows[3][1]), (0, "short"), (n, line)]


def test_hot_line_dealt_by_windows(spark):
    rows = lines_in_a_third(240)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    _, hot = suffix_dedup.splitters(df, 8, 20)
    assert len(hot) > 0
    got = sorted((tuple(r) for r in suffix_dedup.report(df, hot_contexts=20).collect()), key=str)
    assert got == run(spark, rows)
    by_id = {r[:1] + r[1:4] for r in got if r[0] is not None and 0 < r[0] < 240}
    assert by_id == {r[:4] for r in brute([(None, rows[3][1]), *[r for r in rows if r[0] is not None]]) if r[0] is not None and 0 < r[0] < 240}


def test_hot_line_does_not_fill_a_bucket(spark):
    df = spark.createDataFrame(lines_in_a_third(1500), "doc_id long, text string").repartition(3)

    def share(contexts):
        weight = [r.n for r in suffix_dedup._windows_of(df, contexts)[1].selectExpr("bucket", "length(blob) n").groupBy("bucket").sum("n").toDF("b", "n").collect()]
        return max(weight) / sum(weight)

    assert share(50) < share(10**9) / 2


def test_long_text_over_several_segments(spark, monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefgh ", k=30_000))
    rows = [(1, text[:20_000] + text[5_000:9_000]), (2, text[10_000:])]
    assert run(spark, rows) == brute(rows)


def test_picks_agree_between_equal_windows():
    draw = np.random.default_rng(4)
    piece = draw.integers(97, 105, 500).astype(np.uint8)
    data = np.concatenate([draw.integers(97, 105, 321).astype(np.uint8), piece, draw.integers(97, 105, 77).astype(np.uint8), piece])
    starts, firsts, lasts = suffix_dedup.picks(data, np.array([0, len(data)]))
    chosen = {p: s for s, a, b in zip(starts, firsts, lasts, strict=True) for p in range(a, b + 1)}
    assert sorted(chosen) == list(range(len(data) - 99))
    assert all(chosen[321 + i] - (321 + i) == chosen[898 + i] - (898 + i) for i in range(401))


def test_multikey_sort():
    draw = np.random.default_rng(5)
    columns = [draw.integers(0, 4, 500), draw.integers(0, 4, 500), draw.integers(0, 4, 500)]
    order, group = suffix_dedup.multikey_sort(columns)
    keys = list(zip(*(c[order] for c in columns), strict=True))
    assert keys == sorted(keys)
    assert [g for g in group] == [sorted(set(keys)).index(k) for k in keys]


def test_bytes_decide_on_equal_hashes(spark, monkeypatch):
    body = np.frombuffer(b"x" * 100 + b"y" * 100 + b"x" * 100, np.uint8)
    spot, place = np.array([0, 100, 200]), np.array([1, 2, 3])
    again = suffix_dedup._by_bytes(body, spot, place, np.zeros(3, int), np.arange(3), np.ones(3, bool))
    assert list(again) == [2]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(None, None), (None, "")]])
def test_nothing_to_do(spark, rows):
    assert run(spark, rows, 1) == brute(rows)


def test_text_that_is_left(spark):
    text = "".join(random.Random(6).choices("abcdef ", k=300))
    df = spark.createDataFrame([(1, text), (2, "start " + text + " end")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.dedup(df).collect()}
    assert got == {1: text, 2: "start  end"}
