import random
import re

import numpy as np
import pytest

from shelfline.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICES = {name: text for name, _, text in ls.TEMPLATES}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w = tokens(text)
    places = sorted((i, label) for phrase, label in ls.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    labels = ",".join(sorted({label for _, label in places}))
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels


def longest_matches(words, templates):
    """Length of the longest run ending at each word that stands in a template."""
    out = []
    for end in range(1, len(words) + 1):
        size = end
        while size and not any(t[k : k + size] == words[end - size : end] for t in templates for k in range(len(t) - size + 1)):
            size -= 1
        out.append(size)
    return out


TEXTS = [
    "Released under the MIT License.", "MIT  License mit-license; MIT\nLICENSE", "the apache license of the general public license", "General Public\tLicense general public general public license", "", None,
    "nothing here at all", "mit", "license mit", "ÄMIT license", "mit licenseé", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", NOTICES["mit-notice"], NOTICES["bsd-notice"].upper(),
    "x " * 3000 + NOTICES["gpl-notice"] + " y" * 3000, NOTICES["apache-notice"].replace("compliance", "concordance"),
    " ".join(NOTICES["mit-notice"].split()[:12]), "mit license " * 400, "w" * 3_000_000 + " mit license",
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(k, t, "x", 7) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 7), (0, TEXTS[0], "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int")
    return ls.report(df).collect()


def test_phrases_equal_brute_force(scanned):
    assert len(scanned) == len(TEXTS) + 2
    for r in scanned:
        text = TEXTS[r.doc_id or 0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_labels_of_notices(scanned):
    found = {r.doc_id: r for r in scanned}
    expected = {0: "mit", 4: "", 5: "", 6: "", 7: "", 11: "cc-by-nc", 12: "cc-by", 13: "mit", 14: "bsd", 15: "gpl", 16: "apache", 17: ""}
    assert {k: found[k].labels for k in expected} == expected
    assert found[13].score == found[14].score == 1.0 and found[6].score == 0.0 and 0 < found[17].score < 0.2
    assert found[15].spans.startswith("gpl:3000:")


def test_matching_statistics_equal_brute_force():
    draw = random.Random(1)
    templates = [[draw.randrange(4) for _ in range(draw.randrange(2, 14))] for _ in range(6)]
    automaton = ls.Automaton(templates)
    assert len(automaton.steps) <= 2 * sum(map(len, templates)) + 1
    for _ in range(60):
        words = [draw.randrange(5) for _ in range(draw.randrange(1, 30))]
        lengths, states = automaton.read(words)
        assert lengths.tolist() == longest_matches(words, templates)
        for at, (length, state) in enumerate(zip(lengths, states, strict=True), 1):
            own = words[at - length : at]
            places = [(n, k + length) for n, t in enumerate(templates) for k in range(len(t) - length + 1) if t[k : k + length] == own]
            if length:
                assert places == automaton.ends[state]


def test_stretches_lose_no_match():
    """Stepping only through neighbours gives the statistics of whole texts, but for single words."""
    matcher = ls.Matcher()
    text = "to any person obtaining a copy of this text or copies of the software and the work is licensed under the gnu general public license version 3 or so"
    hashes = ls.word_hashes(text)
    number = {int(h): k for k, h in enumerate(matcher.vocabulary)}
    whole, _ = matcher.automaton.read([number.get(int(h), -1) for h in hashes])
    got = np.zeros(len(hashes), int)
    for row, at, sequence in matcher.runs(hashes, np.array([0, len(hashes)])):
        assert row == 0
        got[at : at + len(sequence)] = matcher.automaton.read(sequence)[0]
    assert np.where(whole < 2, 0, whole).tolist() == np.where(got < 2, 0, got).tolist()


def test_chains():
    assert ls.chains([(0, 5, [(0, 5)]), (7, 6, [(0, 13)])], 8) == [(0, 0, 13, 11)]  # goes on after two words left out
    assert ls.chains([(0, 5, [(0, 5)]), (30, 6, [(0, 13)])], 8) == [(0, 0, 5, 5), (0, 30, 36, 6)]  # too far away
    assert ls.chains([(0, 6, [(0, 12)]), (7, 5, [(0, 5)])], 8) == [(0, 0, 6, 6), (0, 7, 12, 5)]  # not forward
    assert ls.chains([(0, 6, [(0, 6)]), (4, 6, [(0, 10)])], 8) == [(0, 0, 10, 10)]  # the overlap counts once
    assert sorted(ls.chains([(0, 6, [(0, 6), (1, 9)])], 8)) == [(0, 0, 6, 6), (1, 0, 6, 6)]


def test_empty_table_and_short_templates(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ls.report(df).count() == 0
    with pytest.raises(ValueError):
        ls.Matcher(phrases=(("mit", "mit"),))
