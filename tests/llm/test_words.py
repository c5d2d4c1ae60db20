import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import common

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "space": r"[^\x20\x09-\x0D]+"}


def expected(texts, kind):
    return [re.findall(PATTERNS[kind], (t or "").translate(UPPER)) for t in texts]


@pytest.mark.parametrize("kind", ["alnum", "space"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="aB1é \t\n.-\x00\x1f日", max_size=30)), max_size=8))
def test_words_agree_with_the_pattern(kind, texts):
    column = pa.array(texts, pa.string())
    hashes, at = common.words(*common.flat(column), common.byte_classes(kind))
    words = expected(texts, kind)
    assert list(np.diff(at)) == [len(w) for w in words]
    known = {}
    for word, h in zip((w for own in words for w in own), hashes, strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 16)
    texts = ["a" * 40, "", "one two three four five six", None, "x " * 50, "b" * 16, "c" * 16 + " " + "a" * 40, "a" * 39, "d" * 33 + " e", "", "f" * 64]
    hashes, at = common.words(*common.flat(pa.array(texts)), common.byte_classes("space"))
    monkeypatch.undo()
    again, at_again = common.words(*common.flat(pa.array(texts)), common.byte_classes("space"))
    assert list(hashes) == list(again) and list(at) == list(at_again)


def test_a_long_word_takes_linear_time():
    import time

    spent = []
    for size in (8 << 20, 32 << 20):
        data = np.concatenate([np.frombuffer(b"ab ", np.uint8), np.full(size, 97, np.uint8), np.frombuffer(b" ab", np.uint8)])
        began = time.process_time()
        hashes, at = common.words(data, np.array([0, len(data)]), common.byte_classes("space"))
        spent.append(time.process_time() - began)
        assert list(at) == [0, 3] and hashes[0] == hashes[2] != hashes[1]
    assert spent[1] < 10 * spent[0] + 1


def test_spans_and_sliced_columns():
    column = pa.array(["skip", "abcabc", None, "abc"]).slice(1)
    data, offsets = common.flat(column)
    assert data.tobytes() == b"abcabcabc" and list(offsets) == [0, 6, 6, 9]
    starts = np.array([0, 3, 6, 1])
    hashes = common.span_hashes_blockwise(data, starts, starts + 3)
    assert hashes[0] == hashes[1] == hashes[2] != hashes[3]


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint8), np.array([1.5]), np.frombuffer(b"xyz", np.uint8)]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and list(a) == list(b)
