import hashlib
import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import simhash, substrings, tiles
from kinweave.workspace import Workspace
from tests.llm.cases import awkward, frame, sentence


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            group[root(b)] = root(a)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, *_), p) in enumerate(zip(rows, prints))), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    for i in range(40):  # families of near copies, some of few words
        words = sentence(rng, rng.choice([3, 30, 400])).split()
        for j in range(4):
            words = [w if rng.random() > 0.01 else "edit" for w in words]
            rows.append((1000 + 10 * i + j, " ".join(words), "en", "a", 1))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == slow_groups(rows)


def test_simhash_blocks_find_every_close_pair(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        prints |= {p ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 3, 4)}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash._links(df, 3, 6, Workspace(spark, "test")).collect()}
    assert got == want


def test_simhash_tiles_connect_what_pairs_do(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3) for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for name, value in (("BLOCK_ROWS", 16), ("MOST_ROWS", 64)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(simhash, "JOINED", 2)
    links = simhash._links(df, 3, 6, Workspace(spark, "test")).collect()
    assert all(((r.u ^ r.v) % (1 << 64)).bit_count() <= 3 for r in links)
    group = {signed(p): signed(p) for p in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in links:
        group[root(r.u)] = root(r.v)
    for a, b in itertools.combinations(prints, 2):
        assert (a ^ b).bit_count() > 3 or root(signed(a)) == root(signed(b))
    assert len(links) < sum((a ^ b).bit_count() <= 3 for a, b in itertools.combinations(prints, 2))


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def slow_removal(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [4, 11, 35])
def test_substrings_match_brute_force(spark, window):
    rng = random.Random(window)
    rows = awkward(window)
    passage = sentence(rng, 60)
    for i in range(30):  # passages in new surroundings, cut at random
        cut = passage.split()[rng.randrange(20) : 60 - rng.randrange(20)]
        rows.append((2000 + i, f"{sentence(rng, rng.randrange(40))} {' '.join(cut)}\n{sentence(rng, rng.randrange(40))}", "en", "a", 1))
    df = frame(spark, rows).repartition(5)
    got = substrings.remove_repeated(df, window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == slow_removal(rows, window)


def test_substrings_empty_table_and_flush(spark, monkeypatch):
    assert substrings.remove_repeated(frame(spark, [])).count() == 0
    rows = awkward()
    df = frame(spark, rows)
    monkeypatch.setattr(substrings, "HELD_HASHES", 50)
    got = substrings.remove_repeated(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == slow_removal(rows, 35)


def test_query_digests(spark, tmp_path):
    frame(spark, awkward(), extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = substrings.op10_substrings(spark, str(tmp_path)).where("doc_id = 41").first()
    assert got.kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert simhash.op1_simhash(spark, str(tmp_path)).where(F.col("doc_id") == 40).first().fingerprint == "0" * 16
