import hashlib
import zlib

import pytest

from shelfline.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every node by walking all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(c - 100 * int(c / 100))
        built = tuple(turns.get(family, [])[:h] + turns[c][h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append(c)
        ends.setdefault(built, []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int")


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def sample():
    rows = []
    for c in [*range(95, 130), 200, 203, 305, 306, -7, -100, -103]:
        for t in range((c * 7) % 9):
            rows.append((c, t, "user" if t % 2 == 0 else None, f"é{t} {c % 3 if t < 4 else c}"))
    rows += [(120, None, None, None), (120, 1, "user", "again"), (99, 50, "user", ""), (99, 50, "user", "")]
    rows += [(None, 1, "user", "lost"), (400, 0, "user", "alone")]
    return rows


@pytest.mark.parametrize("height", [2, 3, 32])
def test_equals_brute_force(spark, height):
    rows = sample()
    rows = [r for r in rows if r[:2] != (120, 1) or r[3] == "again"]
    assert nodes(ct.trie(table(spark, rows), height)) == brute(rows)


def test_order_of_rows_and_partitions_does_not_matter(spark):
    rows = sample()
    expected = nodes(ct.trie(table(spark, rows)))
    assert nodes(ct.trie(table(spark, rows[::-1]).repartition(7))) == expected


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most turns; it is cut by ranges, and bands bound how often a node is repeated."""
    rows = [(7, t, "user", f"t{t % 11}") for t in range(150)] + [(c, t, "user", f"t{t % 11}") for c in range(8, 20) for t in range(c)]
    df = table(spark, rows).repartition(5)
    turns, before = ct.placed_turns(df)
    assert turns.where("conv_id = 7").select("part").distinct().count() > 1 and before
    assert nodes(ct.trie(df, 4)) == brute(rows)


def test_copies_of_one_conversation(spark):
    """Thousands of equal conversations end at one node; their ids are hashed in numeric order across blobs."""
    rows = [(c * 100, t, "user", f"same {t}") for c in range(4000) for t in range(2)]
    got = nodes(ct.trie(table(spark, rows)))
    assert len(got) == 3
    whole = hashlib.sha256(",".join(str(c * 100) for c in range(4000)).encode()).hexdigest()
    assert [r[7] for r in got if r[1] == 2] == [whole]
    assert [r[6] for r in got if r[1] == 0] == [3999 * 12]


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert ct.trie(empty).count() == 0
    with pytest.raises(ValueError):
        ct.trie(empty, 1)
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(c, 0, "user", "gone")]
    assert nodes(ct.trie(table(spark, rows))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
