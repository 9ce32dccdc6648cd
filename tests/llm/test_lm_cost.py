"""What the language model saves must not change what it computes."""

import math

import numpy as np
import pytest

from kinweave.llm import lm


def model(n=400):
    words = [(f"w{i}".encode(), 3 * n - i) for i in range(n)]
    shared: dict = {}
    for w, c in words:
        k = lm.shared_class(w) - lm.GROUPS
        a = shared.get(k, (0, 0))
        shared[k] = (a[0] + c, a[1] + 1)
    v = lm.Vocabulary(words, shared, 50, sum(c for _, c in words) + 50, n + 1)
    params = lm.start_parameters(v)
    rng = np.random.default_rng(5)
    return v, {k: x + rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in params.items()}


def by_definition(v, p, a, b, y):
    q = (p["context"][a] @ p["mix1"] + p["context"][b] @ p["mix2"]).astype(float)
    share = lambda z, k: z[k] - z.max() - math.log(np.exp(z - z.max()).sum())
    k = v.class_of[y]
    out = share(p["target"].astype(float) @ q + p["bias"], k)
    if y < v.n_words:
        group = np.arange(k, v.n_words, lm.GROUPS)
        out += share(p["word"][group].astype(float) @ q + p["word_bias"][group], list(group).index(y))
    return out / math.log(10)


def test_contexts_that_recur_are_scored_once_and_right(monkeypatch):
    v, p = model()
    rng = np.random.default_rng(6)
    c1, c2 = rng.integers(0, 9, (2, 3000)).astype(np.int32)
    y = rng.integers(0, v.end() + 1, 3000).astype(np.int32)
    asked, plain = [], lm._log_total
    monkeypatch.setattr(lm, "_log_total", lambda z: asked.append(z.shape) or plain(z))
    got = lm.Model(v, p).log10(c1, c2, y)
    assert sum(n for n, width in asked if width == lm.CLASSES) == len(set(zip(c1.tolist(), c2.tolist()))) <= 81
    for i in range(0, 3000, 50):
        assert got[i] == pytest.approx(by_definition(v, p, c1[i], c2[i], y[i]), abs=1e-4)


def test_large_logits_stay_in_range():
    z = np.array([[200.0, 199.0, 0.0], [-50.0, 3.0, 61.0]], np.float32)
    want = [200 + math.log(1 + math.exp(-1)), 61.0]
    assert lm._log_total(z) == pytest.approx(want, rel=1e-6)


def test_sums_by_index():
    rng = np.random.default_rng(7)
    for below in (5, 1 << 15, 1 << 20):
        index, rows = rng.integers(0, below, 5000), rng.normal(size=(5000, 16)).astype(np.float32)
        index[:2] = below - 1
        at, sums = lm._summed(index, rows, below)
        want = np.zeros((below, 16))
        np.add.at(want, index, rows)
        assert at.tolist() == sorted(set(index.tolist())) and np.allclose(sums, want[at], atol=1e-3)


def test_draws_follow_shares():
    v, _ = model()
    groups = np.repeat(np.arange(3), 40000)
    drawn = v.draw(groups.reshape(-1, 2), np.random.default_rng(8))
    assert drawn.shape == (60000, 2) and (drawn.ravel() % lm.GROUPS == groups).all()
    found = np.bincount(drawn.ravel(), minlength=v.n_words)[[0, 191, 382, 1, 192, 383]] / 40000
    assert found == pytest.approx(v.share[[0, 191, 382, 1, 192, 383]], abs=0.01)
