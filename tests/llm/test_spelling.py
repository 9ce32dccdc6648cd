"""Near words, forms and roots against comparing all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import spelling
from kinweave.llm.automaton import Automaton
from kinweave.workspace import Workspace
from tests.llm.cases import awkward, frame

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_counts(rows, least_length=5):
    found = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least_length
    return +found


def slow_variants(counts):
    near = {w: [u for u in counts if one_edit(w, u)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def as_dict(rows):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n, letters="abé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 60) for _ in range(n)}


def test_automaton_numbers_and_errors():
    rng = random.Random(1)
    for trial in range(150):
        words = sorted(made(trial, rng.randrange(1, 40), "abñ"[: rng.randrange(1, 4)], 7))
        automaton = Automaton(words)
        asks = words + sorted(made(trial + 1000, 20, "abz", 7)) + [""]
        exact = [rng.randrange(len(w) + 1) for w in asks]
        which, number = automaton.one_error(asks, np.array(exact))
        want = {(i, k) for i, w in enumerate(asks) for k, u in enumerate(words) if u[: exact[i]] == w[: exact[i]] and one_edit(w[exact[i] :], u[exact[i] :])}
        assert sorted(zip(which.tolist(), number.tolist())) == sorted(want)
    endings = Automaton(sorted(a + b for a in "abcdefgh" for b in ("ing", "ings", "ed")))
    assert len(endings.accepts) == 7  # the endings' states are shared


@pytest.mark.parametrize("most", [3, 8192])
def test_variants_of_any_words(spark, monkeypatch, most):
    """Also with keys split until the error's place is known."""
    monkeypatch.setattr(spelling, "MOST_OF_KEY", most)
    counts = made(2, 400) | made(3, 200, "abcdefgh") | {"a": 5, "b": 80, "ab" * 20: 3, "ab" * 20 + "c": 9, "日本語文": 4, "日本語": 9, "🙂ab": 1, "🙃ab": 3}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, key string")
    assert as_dict(spelling.variants(words).collect()) == slow_variants(counts)


def test_near_words_come_once(spark):
    words = spark.createDataFrame([("stone", 1), ("stones", 2), ("atone", 3), ("other", 1)], "word string, n long")
    got = [tuple(r) for r in spelling.near_words(words, Workspace(spark, "t")).collect()]
    assert sorted(got) == [("atone", "stone", 1), ("stone", "atone", 3), ("stone", "stones", 2), ("stones", "stone", 1)]


def test_rows_of_a_word_nulls_and_none(spark):
    schema = "word string, n long"
    got = spelling.variants(spark.createDataFrame([("stone", 1), ("stone", 2), (None, 4), ("", 9), ("stome", 6)], schema)).collect()
    assert as_dict(got) == {"stone": ("stome", "stome", 3, 1, 6), "stome": (None, "stome", 6, 1, None)}
    assert spelling.variants(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], schema), ratio=1)


@pytest.mark.parametrize("held", [50, 1 << 18])
def test_counts_of_awkward_rows(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "COUNTED_BYTES", 3000)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rows = awkward() + [(70, "Straße STRASSE ÀÉÎ àéî a×b÷c naïve-café Ωmega xİy " * 3, "de", "a", 1), (71, "y" * 200 + " " + "zé" * 100, "de", "a", 1)]
    got = {r.word: r.n for r in spelling.word_counts(frame(spark, rows), typos=97, least_length=3).collect()}
    assert got == slow_counts([r[:2] for r in rows], 3)
    assert spelling.word_counts(frame(spark, [])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts = {w: n for w, n in slow_counts(docs).items() if n >= 3}
    assert as_dict(spelling.op12_spelling(spark, "/root/testdata/sf0.001").collect()) == slow_variants(counts)
