import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    ids = {}
    for own in groups.values():
        known = [rows[a][0] for a in own if rows[a][0] is not None]
        for a in own:
            ids[a] = min(known) if known else None
    return sorted(((rows[a][0], ids[a]) for a in ids), key=str), len(groups)


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    rows = []
    shared = [word() for _ in range(30)]
    for i in range(40):
        base = [word() for _ in range(draw.choice([6, 30, 120]))] + (shared if i % 3 == 0 else [])
        rows.append((i * 10, " ".join(base)))
        for j in range(draw.randrange(4)):
            near = list(base)
            for _ in range(draw.choice([0, 1, 2, 8])):
                near[draw.randrange(len(near))] = word()
            rows.append((i * 10 + j + 1, " ".join(near).upper() if j == 1 else ", ".join(near)))
    drift = [word() for _ in range(200)]  # a chain: neighbours are alike, its ends are not
    for i in range(8):
        drift[i * 20 : i * 20 + 15] = [word() for _ in range(15)]
        rows.append((1000 + i, " ".join(drift)))
    rows += [(2000, None), (2001, ""), (2002, "?!"), (2003, ""), (2004, "short one"), (2005, "Short; one"), (None, rows[0][1]), (None, "nobody knows"), (0, rows[0][1])]
    return rows


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in corpus()], "doc_id long, text string, node int, keep string").repartition(4)
    return df, minhash.report(df).collect()


def test_classes_match_brute_force(found):
    _, got = found
    want, groups = brute(corpus())
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want


def test_one_of_each_class_stays(found):
    df, _ = found
    _, groups = brute(corpus())
    kept = minhash.dedup(df)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == groups
    assert not [c for c in Counter(frozenset(shingles(t)) for _, t in rows).items() if c[0] and c[1] > 1]
    assert (0, corpus()[0][1]) in rows  # the smallest id stands for the class


def test_weighted_similarity():
    draw = np.random.default_rng(1)
    elements = draw.integers(1, 2**63, 400).astype(np.uint64)
    a, b = draw.choice([0, 0.3, 1, 2, 7.5], 400), draw.choice([0, 0.3, 1, 2, 7.5], 400)
    b = np.where(draw.random(400) < 0.7, a, b)
    pick = [(elements[w > 0], w[w > 0]) for w in (a, b)]
    bounds = np.cumsum([0, *(len(e) for e, _ in pick)])
    s = minhash.dart_sketch(np.concatenate([e for e, _ in pick]), np.concatenate([w for _, w in pick]), bounds, k=3000)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - truth) < 0.04 and (s != 0).all()


def test_a_sketch_does_not_depend_on_its_neighbours():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(1, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 4000)]
    bounds = np.cumsum([0, *map(len, sets)])
    every = minhash.dart_sketch(np.concatenate(sets), np.ones(bounds[-1]), bounds)
    for i, s in enumerate(sets):
        assert (minhash.dart_sketch(s, np.ones(len(s)), np.array([0, len(s)]))[0] == every[i]).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.report(df).count() == 0 and minhash.dedup(df).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 32), (32, 31)], "a long, b long")
    roots = {r.node: r.root for r in minhash.components(edges, "test").collect()}
    assert {roots[i] for i in range(21)} == {0} and {roots[i] for i in (30, 31, 32, 40)} == {30}


def test_cross_links_join_what_is_similar():
    draw = np.random.default_rng(6)
    base = draw.permutation(1000)[:100]
    sets = [np.sort(np.where(draw.random(100) < p, draw.integers(1000, 10**6, 100), base)).astype(np.uint32) for p in np.linspace(0, 0.25, 40)]
    sets = [np.unique(s) for s in sets]
    node = np.arange(40) * 3
    similar = [(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]

    def joined(pairs):
        group = np.arange(40)
        for a, b in pairs:
            group[group == group[b]] = group[a]
        return [list(group).index(g) for g in group]

    links = minhash.cross_links(sets, node, np.arange(40), 0.8)
    assert joined([(a // 3, b // 3) for a, b in links]) == joined(similar)
    assert len(links) < 40


def test_blocks_of_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 7)
    draw = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        near = list(base)
        for _ in range(draw.randrange(1, 6)):
            near[draw.randrange(100)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    got = minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)[0]


def test_the_kept_row_does_not_depend_on_partitions(spark):
    """Rows equal in id and text differ in other columns, null ids among them; any partitioning keeps the same."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, f"s{k}") for k in range(12)] + [(None, text + " x", f"n{k}") for k in range(12)] + [(2, None, "a"), (2, None, "b"), (3, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = {str(sorted(map(str, minhash.dedup(df.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(found) == 1
