import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontaminate as dec, mixing, quality_rules as qr
from tests.llm.cases import awkward, frame

DATA = "/root/testdata/sf0.01"


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_match_brute_force(spark):
    rows = awkward() + [(70, "a line\na line\n\n \na line | <b> #x", "en", "a", 1), (71, "w1 w2 w3 w4 w5 w6 w7 w8 " * 3, "en", "a", 1)]
    got = qr.quality_rules(frame(spark, rows, extra=False)).collect()
    want = []
    for doc, text, *_ in rows:
        n, *rest = slow_counts(text)
        want.append((doc, n, *rest, n < 20 or 100 * rest[3] > 30 * n))
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in got)
    assert qr.quality_rules(frame(spark, [])).count() == 0


def slow_mcd(x):
    """The estimate with numpy, from sorted values in place of histograms."""
    floor = np.diag(np.square(qr.FLOOR))
    bins = lambda d: np.floor(np.log2(np.maximum(d, 2.0**-20)) * qr.BINS)
    far = lambda mean, cov: np.einsum("na,ab,nb->n", x - mean, np.linalg.inv(cov), x - mean)
    core = lambda d, share: x[bins(d) <= np.sort(bins(d))[int(np.ceil(share * len(x))) - 1]]
    estimate = lambda y, widen: (y.mean(axis=0), widen * np.cov(y.T, bias=True) + floor)
    q = lambda share: np.sort(x, axis=0)[int(np.ceil(share * len(x))) - 1]
    low, mid, high = (np.floor(q(s) * 128) / 128 for s in (0.25, 0.5, 0.75))
    plain = (mid, np.diag(((high - low) / 1.349) ** 2) + floor)
    found = []
    for start in (plain, estimate(core(far(*plain), 0.5), 1.0), estimate(x, 1.0)):
        for _ in range(qr.STEPS):
            start = estimate(core(far(*start), qr.CORE), qr.CORE / qr.CORE_MASS6)
        found.append(start)
    best = min(found, key=lambda p: round(np.log(np.linalg.det(p[1])) / 2, 9))
    return far(*estimate(x[far(*best) <= qr.CHI2_WEIGHT], 1.0))


def points(rows):
    x = np.array([
        (np.log(r.word_chars / r.n_words), np.sqrt(r.n_symbols / r.word_chars), np.sqrt(r.n_dup_lines / (r.n_dup_lines + 10)), np.sqrt(r.n_repeat_words / r.n_words))
        for r in rows
    ])
    return np.round(x * qr.GRID) / qr.GRID


def test_robust_distance_matches_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and source = 'src0'")
    got = [r for r in qr.quality_rules(docs).collect() if not r.base_failed]
    want = slow_mcd(points(got))
    assert np.allclose([r.distance2 for r in got], want, rtol=1e-6, atol=1e-9)
    assert [r.kept for r in got] == list(want <= qr.REJECT) and not all(r.kept for r in got)


def test_outliers_go_from_small_groups_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and source = 'src0'")
    judged = {r.doc_id: r for r in qr.quality_rules(docs).collect() if not r.base_failed}
    bad = [d for d, r in judged.items() if not r.kept][:12]
    good = [d for d, r in judged.items() if r.kept][:60]
    few = docs.where(F.col("doc_id").isin(bad + good))
    for split in (few, few.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 9).cast("string")))):
        kept = {r.doc_id: r.kept for r in qr.quality_rules(split).collect()}
        assert sum(kept[d] for d in bad) <= 1 and sum(kept[d] for d in good) >= 58


def test_salted_and_broadcast_look_ups_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = {r.doc_id: (r.kept, r.distance2) for r in qr.quality_rules(docs).collect()}
    monkeypatch.setattr(qr, "MAX_BROADCAST", -1)
    two = {r.doc_id: (r.kept, r.distance2) for r in qr.quality_rules(docs).collect()}
    assert one == two


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in np.ndindex(len(a), len(b)):
        h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_matches_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 20))
        assert dec.align(a, b)[0] == slow_align(a, b)


def test_decontamination_finds_edited_copies(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").limit(20).collect()]
    rows = awkward()
    for k, (item, text) in enumerate(items):
        words = text.split()
        words = [w.upper() if i % 2 else w for i, w in enumerate(words) if i % 9 != 4]
        rows.append((3000 + k, f"some text before {' '.join(words)} and after", "en", "a", 1))
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "a b c"), (None, items[0][1])], "item_id long, text string").withColumn("lang", F.lit("x"))
    got = dec.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(3000 + k, i) for k, (i, _) in enumerate(items)} | {(3000, None)}
    assert all(0.5 <= r.score < 1 and r.first_word < r.end_word for r in got)
    assert dec.contaminated(frame(spark, []), bench).count() == 0
    assert dec.contaminated(frame(spark, rows), bench.where("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r.doc_id, r.item_id, r.score) for r in dec.contaminated(docs, bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in t and len(dec.tokens(r.text)) >= 8}
    assert plain <= {(d, i) for d, i, _ in one}
    monkeypatch.setattr(dec, "BLOCK_BYTES", 8000)
    assert {(r.doc_id, r.item_id, r.score) for r in dec.contaminated(docs, bench).collect()} == one


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(1, "Which river?"), (2, "seven bridges of old Oslo town here"), (3, "天地玄黃宇宙洪荒日月盈昃"), (4, "9 words with one that differs are still found")], "item_id long, text string")
    rows = [
        (1, "so which RIVER, then", "en", "a", 1), (2, "which big river", "en", "a", 1), (3, "see: seven bridges of old Oslo town, here.", "en", "a", 1),
        (4, "seven bridges of new Oslo town here", "en", "a", 1), (5, "千字文 天地玄黃宇宙洪荒日月盈昃 辰宿", "zh", "a", 1), (6, "天地宇宙", "zh", "a", 1),
        (7, "9 words with one which differs are still found", "en", "a", 1),
    ]
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 4)}


def test_found_pairs_are_those_of_all_alignments(spark):
    """Every text against every item: what has a rare seed in common and aligns well, and nothing else."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(words, rng.integers(8, 30)))) for i in range(25)]
    rows = []
    for k in range(150):
        said = items[rng.integers(25)][1].split()
        edited = [str(rng.choice(words)) if rng.random() < rng.choice([0.05, 0.2, 0.4]) else w for w in said if rng.random() > 0.05]
        rows.append((k, " ".join([*rng.choice(words, 10), *edited, *rng.choice(words, 10)]), "en", "a", 1))
    got = {(r.doc_id, r.item_id): r.score for r in dec.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    has = {w: sum(w in t.split() for _, t in items) for w in words}
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    missed = 0
    for d, text, *_ in rows:
        for i, item in items:
            code = {w: c for c, w in enumerate(words)}
            a, b = (np.array([code[w] for w in t.split()]) for t in (item, text))
            score, same, _ = dec.align(a, b)
            good = score >= len(a) and same >= min(8, len(a))
            rare = {g for g in grams(item) if min(has[w] for w in g) <= 2} or grams(item)
            if (d, i) in got:
                assert good
            elif good:
                missed += 1
                assert not rare & grams(text)
    assert missed <= 0.2 * len(got) and len(got) > 60


def labelled(spark):
    return mixing.label_domains(spark, DATA)


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    targets = {"clean": 0.85, "junk": 0.05, "toxic": 0.10}
    rows = mixing.mix(docs, labelled(spark), targets, keep=["lang"]).collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    total = sum(r.tokens for r in rows)
    for i, d in enumerate(sorted(targets)):
        assert sum(r.tokens * r.rate * r.posterior[i] for r in rows) / total == pytest.approx(targets[d], abs=1e-4)
    assert all(abs(r.copies - r.rate) < 1 and r.residual < 1e-6 for r in rows)
    assert {r.doc_id: len((r.text or "").split()) for r in docs.collect()} == {r.doc_id: r.tokens for r in rows}


def test_mixing_rates_solve_least_squares(spark):
    from kinweave.workspace import Workspace

    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 300)
    t = rng.integers(1, 500, 300)
    table = spark.createDataFrame([(int(n), 1, *map(float, q)) for n, q in zip(t, p)], "tokens long, copies long, p0 double, p1 double, p2 double")
    rate, residual = mixing.fit_rates(table, ["a", "b", "c"], {"a": 6, "b": 3, "c": 1})
    assert residual < mixing.TOLERANCE
    r = np.array([x[0] for x in table.select(rate).collect()])
    assert (r >= 0).all() and np.allclose((t * r) @ p / t.sum(), [0.6, 0.3, 0.1], atol=1e-6)
    assert Workspace


def test_mixing_awkward(spark):
    rows = awkward()
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (None, "a"), (2, None), (3, "a"), (3, "a")], "doc_id long, domain string")
    got = mixing.mix(frame(spark, rows), labels, {"a": 1, "b": 1}).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    assert next(r for r in got if r.doc_id == 40).tokens == 0
    assert mixing.mix(frame(spark, []), labels, {"a": 1}).count() == 0
    assert {r.rate for r in mixing.mix(frame(spark, rows), labels.where("false"), {"a": 1}).collect()} == {1.0}
    for bad in ({}, {"a": -1}, {"a": 0}):
        with pytest.raises(ValueError):
            mixing.mix(frame(spark, rows), labels, bad)
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), labels, {"z": 1})
