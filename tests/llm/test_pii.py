import re

import pytest

from shelfline.llm import pii


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def naive(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


@pytest.mark.parametrize(
    "text",
    [
        "", "a@b", "a@b.c", "x a.b+c@mail-1.example.com, d@e.f.g.", "a@b@c.d", "@@a@b.c@d.e", "é@b.cd", "1.2.3.4", "1.2.3.4.5", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 x", "+12345678", "+(1) 2", "+1 23  456 789 0.",
        "4111 1111 1111 1111 22", "a" * 3000 + "@" + "b" * 3000, "9" * 300 + "." + "1.1.1", "日本 a@b.c 10.0.0.1 +49 170 1234567",
    ],
)
def test_patterns(text):
    assert pii.find(text) == naive(text)
    assert pii.may_hold(text.encode()) or not naive(text)


FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def rows():
    out = []
    for i in range(40):
        out.append((i, " ".join(FILL[(i + j) % len(FILL)] for j in range(15))))
    for i in range(3):  # Zanzibarian is only ever seen with this address, in different contexts
        out.append((100 + i, f"{FILL[i]} {FILL[i + 3]} Zanzibarian lorem jane.roe@mail.example.com ipsum {FILL[i + 5]}"))
    out += [(200, "plain lorem 10.1.2.3 ipsum"), (200, "plain lorem 10.1.2.3 ipsum"), (None, "call +1 (988) 555-2485 dolor"), (300, None), (301, "")]
    return out


def test_revealing_terms(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, base string, n int")
    got = pii.report(df).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows():
        spans = by[i][0].spans
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in naive(text or ""))
        if i in (100, 101, 102):
            at = text.index("Zanzibarian")
            assert spans.startswith(f"term:{at}:{at + 11},") and spans.split(",")[1].startswith("email:")
        else:
            assert spans == base  # common words reveal nothing; clean documents stay as they are
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert "Zanzibarian" not in text[100] and "[EMAIL]" in text[100] and text[200] == "plain lorem [IP] ipsum" and text[0] == rows()[0][1]
    assert clean.count() == len(rows())


def test_copies_are_no_evidence(spark):
    text = "unique words around jane.roe@mail.example.com stand here"
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    assert all(r.spans == "email:20:45" for r in pii.report(df).collect())


def test_copies_hide_nothing(spark):
    texts = [f"{FILL[i]} {FILL[i + 3]} Zanzibarian lorem jane.roe@mail.example.com ipsum {FILL[i + 5]}" for i in range(2)]
    plain = [text for _, text in rows()[:40]] * 10  # so many that no word of them is mostly beside the address
    every = plain + texts * 60  # two contexts, each in 60 copies
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    for i, text in enumerate(every):
        at = text.find("Zanzibarian")
        assert (f"term:{at}:{at + 11}" in got[i].split(",")) == (i >= len(plain))
        assert i >= len(plain) or got[i] == ""
    assert not any("Zanzibarian" in r.text for r in pii.sanitise(df).collect())


def test_terms_away_from_the_mention(spark):
    texts = [f"{FILL[i]} {FILL[i + 3]} Zanzibarian lorem jane.roe@mail.example.com ipsum {FILL[i + 5]}" for i in range(3)]
    texts[0] += " " + " ".join(FILL) + " yours zanzibarian"  # 20 words away
    texts.append("dolor ZANZIBARIAN sit")  # no mention in the text
    every = [" ".join(FILL[(i + j) % len(FILL)] for j in range(15)) for i in range(400)] + texts
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    for i, text in enumerate(every):
        places = [f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)zanzibarian", text)]
        assert [s for s in got[i].split(",") if s.startswith("term") and s in places] == places
    assert not any("zanzibarian" in r.text.lower() for r in pii.sanitise(df).collect())


def test_contexts_are_of_whole_words():
    long = "日" * 700
    text = f"x {long} a@b.cd {long} y"
    near = pii.contexts(text, pii.find(text))
    assert [text[x[3] : x[4]] for x in near] == ["x", long, long, "y"]
    text = "w " * 500 + "é1.2.3.4 " + "v" * 390 + " " + "u" * 500 + " t"  # é1 is one word, cut by the address
    near = pii.contexts(text, pii.find(text))
    assert [text[x[3] : x[4]] for x in near] == ["w"] * 8 + ["v" * 390, "u" * 500, "t"]


def test_repeats_near_one_mention(spark):
    text = "jane.roe@mail.example.com name jane.roe@mail.example.com"
    near = pii.contexts(text, pii.find(text))
    assert sum(x[6] for x in near) == 1 and sum(x[7] for x in near) == 2  # one word near two mentions


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(df).count() == 0 and pii.sanitise(df).count() == 0


def test_term_counts(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    import pyarrow as pa

    from shelfline.llm import common

    hashes, _ = common.words(*common.flat(pa.array(["lorem", "zanzibarian"])), common.byte_classes("alnum"))
    terms = spark.createDataFrame([(int(h),) for h in hashes.view("int64")], "term long")
    got = {r.term: r.n for r in pii.term_counts(df, terms).collect()}
    every = [w for _, t in rows() for w in re.findall(r"[a-z0-9]+", (t or "").lower())]
    assert [got[int(h)] for h in hashes.view("int64")] == [every.count("lorem"), 3] and got[None] == len(every)


def test_long_runs_of_digits_take_linear_time():
    import time

    began = time.process_time()
    text = "7" * 1_000_000 + " 1.2.3.4.5.6.7.8 " + "1." * 100_000 + "x" + "9" * 300_000 + ".1.2"
    found = [text[a:b] for kind, a, b in pii.find(text) if kind == "ip"]
    assert time.process_time() - began < 3
    assert found[:2] == ["1.2.3.4", "5.6.7.8"] and len(found) == 2 + 100_000 // 4


def test_terms_become_their_narrowest_safe_class(spark):
    """Zanz is a common beginning, xylo is not but xy is, and no class of qwerty is."""
    plain = [" ".join(FILL[(i + j) % len(FILL)] for j in range(12)) + " zanzibar zanzig xyster xyz" for i in range(200)]
    telling = [f"{FILL[i]} Zanzibarian qwerty xylophone jane.roe@mail.example.com {FILL[i + 5]}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(plain + telling)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert [got[i] for i in range(200)] == plain
    assert [got[200 + i] for i in range(3)] == [f"{FILL[i]} Zanz*  xy* [EMAIL] {FILL[i + 5]}" for i in range(3)]


def test_disclosures_equal_brute_force(spark):
    import random
    from math import log2

    from pyspark.sql import functions as F

    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    mails = [f"m{i}@a.example.com" for i in range(4)]
    texts = [" ".join(mails[draw.randrange(4)] if draw.random() < 0.04 else draw.choice(vocabulary) for _ in range(draw.randrange(5, 60))) for _ in range(120)]
    texts += texts[:10]
    total, counts, mentions, both, seen = 0, {}, {}, {}, {}
    for text in texts:
        tokens = text.split()
        for w in tokens:
            for part in re.findall(r"[a-z0-9]+", w):
                total += 1
                counts[part] = counts.get(part, 0) + 1
        known = set()
        for at, token in enumerate(tokens):
            if "@" not in token:
                continue
            side = [k for k in range(len(tokens)) if "@" not in tokens[k]]
            near = [k for k in side if k < at][-pii.AROUND :] + [k for k in side if k > at][: pii.AROUND]
            if not near:
                continue
            mentions[token] = mentions.get(token, 0) + 1
            for k in near:
                seen.setdefault((token, tokens[k]), set()).add(" ".join(tokens[n] for n in near))
                both[token, tokens[k]] = both.get((token, tokens[k]), 0) + ((token, k) not in known)
                known.add((token, k))
    wanted = sorted(log2(n / counts[w] * total / mentions[e]) / log2(total / mentions[e]) for (e, w), n in both.items() if len(seen[e, w]) >= 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", F.xxhash64("text").alias("th"), "text")
    near = rows.mapInArrow(pii._scan, pii._FOUND).select(F.explode("near").alias("x")).select("x.*")
    joint = pii.supported(near)
    got = sorted(r.disclosure for r in pii.disclosures(joint, near, pii.term_counts(df, joint.select("term").distinct())).collect())
    assert len(got) == len(wanted) > 100 and all(abs(a - b) < 1e-9 for a, b in zip(got, wanted, strict=True))
