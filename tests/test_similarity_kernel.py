"""Names of a batch compared at once, against one pair at a time."""

import random

import numpy as np
import pandas as pd

from kinweave.functions import similarity as sim

LETTERS = "abcdefaeiouşé"


def varied(rng, token):
    letters, k, r = list(token), rng.randrange(len(token)), rng.random()
    if r < 0.3:
        letters[k] = rng.choice(LETTERS)
    elif r < 0.5 and len(letters) > 1:
        del letters[k]
    elif r < 0.7 and len(letters) > 1:
        letters[k - 1], letters[k] = letters[k], letters[k - 1]
    return "".join(letters)


def tokens(rng, n):
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([1, 1, 2, 3, 5, 6, 7, 8, 9, 12, 15]))) for _ in range(n)]
    made += ["x" * 70, "x" * 69 + "y", "ab\0", "mohammed", "md", "laxmi", "lakshmi"]
    return made + [varied(rng, t) for t in made for _ in range(2)]


def test_tokens():
    rng = random.Random(1)
    told = tokens(rng, 200)
    a = np.array([rng.randrange(len(told)) for _ in range(9000)])
    b = np.array([rng.randrange(len(told)) if rng.random() < 0.5 else (i * 2 + 207) % len(told) for i in a])
    base, same = sim.jaro_of(told, a, b)
    assert base.tolist() == [sim.jaro(told[i], told[j]) for i, j in zip(a, b)]
    assert sim.winkler(base, same).tolist() == [sim.jaro_winkler(told[i], told[j]) for i, j in zip(a, b)]
    assert [len(x) for x in sim.jaro_of([], np.array([], int), np.array([], int))] == [0, 0]
    base, same = sim.jaro_of(["", "a"], np.array([0, 0, 1]), np.array([0, 1, 0]))
    assert base.tolist() == [1.0, 0.0, 0.0]


def test_names():
    rng = random.Random(2)
    told = tokens(rng, 150)
    names = [tuple(rng.choice(told) for _ in range(rng.randrange(0, 5))) for _ in range(900)]
    pairs = [(n, tuple(varied(rng, t) for t in n)) if rng.random() < 0.6 else (n, rng.choice(names)) for n in names]
    assert sim.name_similarities(pairs).tolist() == [sim.name_similarity(a, b) for a, b in pairs]
    assert sim.name_similarities([]).tolist() == [] and sim.name_similarities([((), ()), ((), ("a",))]).tolist() == [0.0, 0.0]


def test_nulls_and_repeats():
    a, b = pd.Series(["martha", None, "a", "martha"]), pd.Series(["marhta", "x", None, "marhta"])
    got = sim.jaro_udf.func(a, b)
    assert got.isna().tolist() == [False, True, True, False] and abs(got[0] - 0.9444444) < 1e-6 and got[0] == got[3]
    names = sim.name_similarity_udf.func(pd.Series([["anand", "rao"], None, ["anand", "rao"]]), pd.Series([["anand", "r"], ["x"], ["anand", "r"]]))
    assert names.tolist() == [sim.name_similarity(["anand", "rao"], ["anand", "r"]), 0.0, names[0]]
