"""The near-copy stage finds its pairs by SimHash and settles them by shingle sets."""

import itertools
import random

import numpy as np

import corpus_pipeline as cp
from kinweave.llm import similar, simhash
from tests.llm.cases import SCHEMA, sentence


def near_copy(rng, words, share):
    n = int(len(words) * share)
    return words[:n] + sentence(rng, len(words) - n).split()


def parts(n, links):
    group = list(range(n))
    for a, b in links:
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
    return [group.index(g) for g in group]


def test_first_word_is_the_simhash_of_the_shingles():
    rng = random.Random(1)
    for n in (5, 6, 40, 9000):
        text = " ".join(f"W{i}{w}" for i, w in enumerate(sentence(rng, n).split()))
        words = similar._words(text)
        assert int(similar.sketch(similar.shingles(words, 5))[0]) == simhash.fingerprint(text, 5)


def test_bits_of_similar_sets_differ_as_said():
    rng, found = np.random.default_rng(2), []
    for _ in range(200):  # 8 / 9 of each set in common: similarity 0.8
        a, b = rng.integers(0, 1 << 64, (2, 900), dtype=np.uint64)
        b[:800] = a[:800]
        found.append(int(similar._differing(similar.sketch(a), similar.sketch(b))))
    assert abs(np.mean(found) - 39) < 2 and max(found) <= similar.FAR
    assert similar.missed(0.8) < 1e-4 and similar.missed(0.8, similar.LEAST_BITS) < 2e-6


def test_close_links_match_brute_force():
    rng = np.random.default_rng(3)
    loose = rng.integers(0, 1 << 64, (1500, similar.WORDS), dtype=np.uint64)
    flips = np.packbits(rng.random((1200, similar.BITS)) < rng.choice([0.05, 0.17, 0.2], 1200)[:, None], axis=1).view(np.uint64)
    for marks in (loose[:60], np.concatenate((loose[:300], flips[:200] ^ loose[0])), np.concatenate((loose, flips ^ loose[0]))):
        marks = marks[rng.permutation(len(marks))]
        near = [np.flatnonzero(similar._differing(marks, m) <= similar.FAR) for m in marks]
        links = similar.close_links(marks)
        assert all(j in near[i] for i, j in links)
        todo, want = set(range(len(marks))), []
        while todo:
            seen, new = set(), {min(todo)}
            while new:
                seen |= new
                new = set(itertools.chain.from_iterable(near[i].tolist() for i in new)) - seen
            want.append(sorted(seen))
            todo -= seen
        got = parts(len(marks), links)
        assert sorted(want) == sorted([i for i, g in enumerate(got) if g == h] for h in set(got))


def test_pairs_come_from_simhash_alone(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for i in range(20):
        words = sentence(rng, 100).split()
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join(near_copy(rng, words, 0.93)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert cp.near_copies(spark, docs, "").count() == 20
    monkeypatch.setattr(similar, "_links", lambda marks: spark.createDataFrame([], "u long, v long"))
    assert cp.near_copies(spark, docs, "").count() == 40
    assert cp.near_copies(spark, docs.union(docs), "").count() == 40


def test_close_fingerprints_are_not_enough(spark):
    rng, rows = random.Random(5), []
    for i in range(20):  # half in common or so: close fingerprints for some, sets that differ
        words = sentence(rng, 120).split()
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join(near_copy(rng, words, 0.8)), "en", "a", 1)]
    far = [similar._differing(*(similar.sketch(similar.shingles(similar._words(t), 5)) for t in (a[1], b[1]))) for a, b in zip(rows[::2], rows[1::2])]
    assert min(far) <= similar.FAR
    assert cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 40
