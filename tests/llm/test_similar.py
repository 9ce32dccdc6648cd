import itertools
import random

import corpus_pipeline as cp
from kinweave.llm import similar
from tests.llm.cases import SCHEMA, awkward, frame, sentence


def as_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a or b else True


def planted(seed):
    """Texts with copies of 0.7 to 0.99, made by edits here and there and by words cut off."""
    rng, rows = random.Random(seed), awkward(seed)
    for i in range(40):
        words = sentence(rng, rng.choice([3, 30, 80, 400])).split()
        for j in range(6):
            words = words[: len(words) - rng.randrange(len(words) // 8 + 1)]
            rate = rng.choice([0, 0.005, 0.02, 0.04])
            words = [w if rng.random() > rate else f"edit{rng.randrange(9)}" for w in words]
            rows.append((1000 + 10 * i + j, " ".join(words), "en", "a", 1))
    return rows


def slow_groups(rows):
    sets, group = [as_set(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if alike(sets[a], sets[b]):
            group[root(b)] = root(a)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((r[0], least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def test_similar_texts_match_brute_force(spark):
    rows = planted(5)
    got = similar.similar_texts(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == slow_groups(rows)


def test_stage_leaves_no_pair_of_near_copies(spark):
    rng, rows = random.Random(6), []
    for i in range(20):  # a tenth of the tail is other words: similarity 0.82 or so, many bits apart
        words = sentence(rng, 100).split()
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join(words[:90]) + " " + sentence(rng, 10), "en", "a", 1)]
    kept = cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2))
