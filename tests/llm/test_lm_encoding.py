"""Texts are split and looked up once; what is read afterwards are the ids of their tokens."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import lm
from tests.llm.cases import awkward

ODD = [None, "", " \n\t ", "a\x1cb \x0bC\x85 É\x00x", " x", "y ", "x\ry\fX"]


def plain(text):
    return (text or "").encode().lower().split()


def vocabulary(texts, frequent):
    count = Counter(w for t in texts for w in plain(t))
    shared: dict = {}
    for w, c in count.items():
        k = lm.shared_class(w) - lm.GROUPS
        a = shared.get(k, (0, 0))
        shared[k] = (a[0] + c, a[1] + 1)
    return lm.Vocabulary(count.most_common(frequent), shared, len(texts), sum(count.values()) + len(texts), len(count) + 1)


def batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns.values()], list(columns))


def encoded(v, column):
    n = len(column)
    rows = batch(id=list(range(n)), held_out=[False] * n, text=column)
    return pa.Table.from_batches(list(lm._encoding(SimpleNamespace(value=v))(iter([rows])))).combine_chunks().to_batches()[0]


@pytest.mark.parametrize("size", [1, 1000, 1 << 23])
def test_ids_counts_and_rare_words(monkeypatch, size):
    monkeypatch.setattr(lm, "HELD_BYTES", size)
    monkeypatch.setattr(lm, "HELD_TOKENS", size)
    monkeypatch.setattr(lm, "MODELLED", 300)
    texts = ODD + [r[1] for r in awkward()]
    counted: Counter = Counter()
    for part in lm._counting(iter([batch(text=texts[:9]), batch(text=pa.array([], pa.string())), batch(text=texts[9:])])):
        counted.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
    assert counted == Counter(w for t in texts for w in plain(t))
    v = vocabulary(texts, 500)
    for column in (pa.array(texts), pa.array(["before", *texts])[1:], pa.array(texts, pa.large_string())):
        got = encoded(v, column)
        laid = [ids[a:b] for ids, s in lm._laid(got["ids"], v.id_type()) for a, b in zip(s, [*s[1:], len(ids)])]
        assert [x.tolist() for x in laid] == [v.ids(plain(t)).tolist() for t in texts]
        assert got["n_tokens"].to_pylist() == [len(plain(t)) + 1 for t in texts]
        assert got["n_known"].to_pylist() == [sum(w in v.rank for w in plain(t)) + 1 for t in texts]
        rare = [dict(zip(*x)) for x in zip(got["rare"].to_pylist(), got["rare_n"].to_pylist())]
        assert rare == [Counter(w for w in plain(t) if w not in v.rank) for t in texts]


def test_texts_that_are_not_utf8_are_bytes():
    offsets, data = np.array([0, 5, 7], np.int32), b"A\xff b\xc3 x"
    [(words, place, bounds)] = lm._split(pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    assert [words[i].as_py() for i in place.tolist()] == [b"a\xff", b"b\xc3", b"x"] and bounds.tolist() == [0, 2, 3]


def test_each_different_word_is_looked_up_once(monkeypatch):
    texts = [r[1] for r in awkward()]
    v, asked, plainly = vocabulary(texts, 500), [], lm.Vocabulary.ranks
    monkeypatch.setattr(lm.Vocabulary, "ranks", lambda self, words: asked.extend(words) or plainly(self, words))
    rows, held = encoded(v, pa.array(texts)), SimpleNamespace(value=(v, lm.start_parameters(v)))
    list(lm._training(held)(iter([rows.select(["ids"])])))
    [scored] = lm._scoring(held)(iter([rows.select(["id", "score", "ids"])]))
    assert sorted(set(asked) - {b""}) == sorted({w for t in texts for w in plain(t)}) and len(asked) == len(set(asked))
    model = lm.Model(v, held.value[1])
    for t, score, base in zip(texts, scored["score"].to_pylist(), rows["score"].to_pylist()):
        ids = v.ids(plain(t))
        want = (model.log10(*lm.contexts(ids, v.end()), ids) - v.within[v.class_of[ids]]).sum() + base
        assert score == pytest.approx(want, rel=1e-5)


def test_contexts_do_not_cross_texts():
    one, two = lm.contexts(np.array([1, 2, 9, 9, 3, 9]), 9, np.array([0, 3, 4]))
    assert one.tolist() == [9, 1, 2, 9, 9, 3] and two.tolist() == [9, 9, 1, 9, 9, 9]


def test_a_step_follows_the_gradient():
    texts = [" ".join(f"w{i}" for i in range(j, 400)) for j in range(0, 400, 20)]
    v = vocabulary(texts, 400)
    rng = np.random.default_rng(4)
    p = {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for k, x in lm.start_parameters(v).items()}
    c1, c2, y = rng.integers(0, v.end() + 1, (3, 500)).astype(np.int32)
    trainer = lm.Trainer(p, v, 3)
    trainer.step(c1, c2, y)
    draws = np.random.default_rng(3)
    drawn = np.minimum(np.searchsorted(np.cumsum(v.noise), draws.random(lm.NOISE)), lm.CLASSES - 1)
    k, own = v.class_of[y], np.flatnonzero(y < v.n_words)
    words = v.draw(np.repeat(k[own], lm.WORD_NOISE).reshape(-1, lm.WORD_NOISE), draws)

    def loss(p):
        q = p["context"][c1] @ p["mix1"] + p["context"][c2] @ p["mix2"]
        of_class = lambda i: p["target"][i] @ q.T + (p["bias"][i] - np.log(lm.NOISE * v.noise[i]))[:, None]
        of_word = lambda w: (p["word"][w] * q[own]).sum(axis=1) + p["word_bias"][w] - np.log(lm.WORD_NOISE * v.share[w])
        true = of_class(np.arange(lm.CLASSES))[k, np.arange(len(y))]
        total = np.logaddexp(0, -true).sum() + np.logaddexp(0, of_class(drawn)).sum()
        return total + np.logaddexp(0, -of_word(y[own])).sum() + sum(np.logaddexp(0, of_word(w)).sum() for w in words.T)

    exact = {name: x.astype(float) for name, x in p.items()}
    often = np.bincount(y[own]).argmax()
    places = {"context": (c1[0], 2), "target": (k[1], 3), "bias": (drawn[0],), "word": (often, 5), "word_bias": (often,), "mix1": (3, 4), "mix2": (7, 0)}
    for name, at in places.items():
        up, down = ({**exact, name: exact[name].copy()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        g = (loss(up) - loss(down)) / 2e-4 / len(y) * 16
        moved = exact[name][at] - float(trainer.p[name][at])
        assert moved == pytest.approx(lm.RATE * g / np.sqrt(0.01 + g * g), rel=0.02, abs=1e-5), name
