"""What the hidden Markov model's training works on at once."""

from __future__ import annotations

import numpy as np

from marketlens.llm import hmm_score


def test_texts_of_like_length_are_worked_on_together(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.tile([300, 2, 2, 2], 20)
    begin = np.cumsum(lengths) - lengths
    codes = rng.integers(0, 5, lengths.sum())
    model = hmm_score.Model(np.full(3, 1 / 3), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    whole, steps, inner = hmm_score.expect(model, codes, begin, lengths), [], hmm_score._expect

    def counted(model, codes, begin, lengths, *rest):
        steps.append(int(lengths.max()))
        return inner(model, codes, begin, lengths, *rest)

    monkeypatch.setattr(hmm_score, "_expect", counted)
    lengths_in_turn = np.concatenate([lengths, np.full(600, 2)])
    more = np.concatenate([begin, lengths.sum() + 2 * np.arange(600)])
    hmm_score.expect(model, np.concatenate([codes, rng.integers(0, 5, 1200)]), more[::-1], lengths_in_turn[::-1], 1000)
    assert sum(x == 300 for x in steps) <= 7 and min(steps) == 2
    steps.clear()
    parts = hmm_score.expect(model, codes, begin, lengths, 500)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))
    steps.clear()
    one = np.tile([300, *[2] * 100], 20)  # a long text among short ones: 300 steps for each cut of 500 tokens before
    hmm_score.expect(model, rng.integers(0, 5, one.sum()), np.cumsum(one) - one, one, 500)
    assert sum(steps) < 12 * 300 + 40, sum(steps)
