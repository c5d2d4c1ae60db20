"""What a task of the language model holds in Python does not grow with vocabulary or chunk."""

import tracemalloc

import numpy as np
import pyarrow as pa

from shelfline.llm import lm_scoring


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_normalising_holds_a_tile_of_contexts_and_tokens():
    model = lm_scoring.start(np.arange(60_000, 0, -1))
    whole = model["R"][:300] @ model["C"] @ model["R"].T + (model["b"] + model["log_noise"])
    assert np.allclose(lm_scoring.log_sums(model, 0, 300), np.log(np.exp(whole.astype(np.float64)).sum(1)), atol=1e-5)
    assert np.allclose(lm_scoring.log_sums(model, 0, 300, rows=7, columns=999), lm_scoring.log_sums(model, 0, 300), atol=1e-5)
    assert peak(lambda: lm_scoring.log_sums(model, 0, 300)) < 64e6  # 185 MB while all tokens were summed at once


def test_counting_a_chunk_holds_some_texts_at_a_time(monkeypatch):
    texts = pa.table({"doc_id": range(3_000), "text": [" ".join(f"w{(i * 7 + j) % 5_000}" for j in range(800)) for i in range(3_000)], "held_out": [i % 5 == 1 for i in range(3_000)]})
    ask = lm_scoring._ask(4)
    got = ask((pa.scalar(0),), texts)
    assert peak(lambda: ask((pa.scalar(0),), texts)) < 90e6  # of 2.4 million tokens
    monkeypatch.setattr(lm_scoring, "_SLICE", 1 << 40)
    assert ask((pa.scalar(0),), texts).equals(got)
