"""Tests of the round's finding on op4_lm_score: seconds of the network's work."""

import numpy as np
import pyarrow as pa

from touchline.llm import gru_lm


def trained_weights(texts):
    p = gru_lm.initial(np.bincount(np.concatenate(texts), minlength=gru_lm.WORDS + gru_lm.VOCABULARY).astype(float))
    sums = {n: np.full_like(v, gru_lm.FIRST) for n, v in p.items()}
    for k in range(0, len(texts), 2):
        gru_lm.train(p, np.concatenate(texts[k : k + 2]), sums)
    return p


def some_texts(seed, sizes):
    rng = np.random.default_rng(seed)
    return [np.array([*rng.geometric(0.002, n).clip(1, 1100), gru_lm.END], np.int32) for n in sizes]


def test_scoring_takes_no_more_steps_than_its_longest_lane(monkeypatch):
    """A long text and short ones side by side: the short ones follow each other while the long one goes on."""
    texts, steps, tanh = some_texts(0, [399, *[29] * 15]), [], np.tanh
    p = gru_lm.initial(np.ones(gru_lm.WORDS + gru_lm.VOCABULARY))
    alone = [gru_lm.log_likelihood(p, [t])[0] for t in texts]
    monkeypatch.setattr(gru_lm, "SCORED_AT_ONCE", 4)
    monkeypatch.setattr(np, "tanh", lambda *a, **b: steps.append(1) or tanh(*a, **b))
    assert np.allclose(gru_lm.log_likelihood(p, texts), alone, rtol=1e-6)
    assert len(steps) == 400


def test_scores_do_not_hang_on_what_is_scored_beside():
    for seed in range(3):
        texts = some_texts(seed, np.random.default_rng(seed).integers(1, 400, 200))
        p, order = trained_weights(texts), np.random.default_rng(9).permutation(200)
        apart = np.empty(200)
        for k in range(8):
            apart[order[k::8]] = gru_lm.log_likelihood(p, [texts[i] for i in order[k::8]])
        assert np.abs(gru_lm.log_likelihood(p, texts) - apart).max() < 2e-6  # natural logarithms


def test_word_lists():
    odd = ["  a B\x0b\x0cc \x1c\x1d\x85 Ä x  d ", "", " \n", None, "x\ty\r\nz", "É A　b", "\x00 a\x00b", "One"]
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    want = [[w.decode() for w in (t or "").encode().translate(lower).split()] for t in odd]
    assert [x or [] for x in gru_lm.word_lists(pa.array(odd)).to_pylist()] == want
    assert [x or [] for x in gru_lm.word_lists(pa.array(odd).slice(3, 3)).to_pylist()] == want[3:6]
