import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bytetok, langid, lm, quality_model, toxicity
from tests.llm.cases import awkward, frame

DATA = "/root/testdata/sf0.1"


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_words_and_hashes():
    texts = [b"", b" a  bb\tccc\n", "ünï   漢".encode(), b"\x0b\x1cx", b"a", b"  ", b"bb ccc"]
    for limit in (1, 8, 1 << 20):
        seen = []
        for c in bytetok.chunks(texts, limit):
            h = bytetok.word_hashes(c.data, c.starts, c.ends, step=2)
            for i in range(c.n_texts):
                span = slice(*c.bounds[i : i + 2])
                words = [c.data[s:e].tobytes() for s, e in zip(c.starts[span], c.ends[span])]
                assert words == texts[c.first + i].split()
                seen += zip(words, h[span].tolist())
        assert len({w for w, _ in seen}) == len(set(seen)) == len({h for _, h in seen})


def test_window_hashes_depend_on_words_alone():
    words = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    twice = bytetok.Windows(np.concatenate([words, words]))
    for n in (1, 9, 35):
        assert (twice.at(np.arange(50 - n + 1), n) == twice.at(np.arange(50, 100 - n + 1), n)).all()


def numeric_gradient(f, params, key, at, step=1e-3):
    out = []
    for sign in (1, -1):
        p = {k: v.astype(np.float64).copy() for k, v in params.items()}
        p[key][at] += sign * step
        out.append(f(p))
    return (out[0] - out[1]) / (2 * step)


def test_quality_gradients():
    rng = np.random.default_rng(1)
    bags = []
    for n in (1, 3):
        sizes = np.array([5] * n, np.int32)
        bags.append((rng.integers(0, 20, 5 * n).astype(np.int32), sizes, rng.random((n, quality_model.N_STATS)).astype(np.float32)))
    y = np.array([0.0, 1.0], np.float32)
    p = {k: v.astype(np.float64) for k, v in quality_model.train(bags, y).items()}

    def loss(q):
        out = 0
        for (b, s, x), label in zip(bags, y):
            words = np.concatenate(([0], np.cumsum(s)))
            z = quality_model.attend(q, quality_model.encode(q, b, words, x)[1], np.array([0, len(s)]))[3]
            v = quality_model._sigmoid(z @ q["out"] + q["out_bias"])[0]
            out -= label * math.log(v) + (1 - label) * math.log(1 - v)
        return out / 2

    g = quality_model._gradients(p, bags, y)
    for key in g:
        at = tuple(0 for _ in g[key].shape) if key != "embed" else (int(bags[1][0][0]), 0)
        assert g[key][at] == pytest.approx(numeric_gradient(loss, p, key, at, 1e-2), rel=0.05, abs=2e-5)


def test_quality_held_out(spark):
    got = quality_model.score_quality(docs(spark), labels(spark)).join(labels(spark), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = ([r.predicted for r in test if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_toxicity_held_out_and_group_names(spark):
    got = toxicity.score_toxicity(docs(spark), labels(spark)).join(labels(spark), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted for r in test if r.toxic]) > 0.85 and np.mean([r.predicted for r in test if not r.toxic]) < 0.02


def test_toxicity_swaps_keep_group_names_neutral():
    rng = np.random.default_rng(1)
    plain = ["river", "stone", "light", "carry"]
    texts, y = [], []
    for i in range(400):  # one group is named in most toxic texts and few others
        bad = i % 2
        words = [*rng.choice(plain, 6), *(["women"] if rng.random() < (0.8 if bad else 0.2) else ["men"]), *(["vilest"] if bad and rng.random() < 0.7 else [])]
        texts.append(" ".join(words).encode())
        y.append(float(bad))
    parts = list(toxicity.sentences(texts))
    words = np.concatenate([w for w, _, _ in parts])
    sizes = np.concatenate([np.diff(np.append(f, len(w))) for w, f, _ in parts])
    counts = np.concatenate([np.diff(b) for _, _, b in parts])

    def gap(weight):
        old, toxicity.SWAP = toxicity.SWAP, weight
        try:
            p = toxicity.train(words, sizes, counts, np.array(y))
        finally:
            toxicity.SWAP = old
        a, b = toxicity.scores(p, [b"women carry light", b"men carry light"])
        return a - b, toxicity.scores(p, [b"vilest stone"])[0]

    (free, _), (tied, vile) = gap(0.0), gap(5.0)
    assert free > 0.2 and abs(tied) < free / 3 and vile > 0.5


def test_language_held_out(spark):
    got = langid.identify(docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.99


def test_every_language_is_learned_and_numerals_are_no_letters(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_TAUGHT", 200)
    rows = [(i, "ab ba " * 200, "aa", "s", 1) for i in range(3000)] + [(5000 + i, "xyz zyx " * 200, "zz", "s", 1) for i in range(100)]
    rows += [(6000, "½ ² ① Ⅷ 12", "aa", "s", 1)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, rows)).collect()}
    assert {got[5000 + i] for i in range(100)} == {"zz"} and got[3] == "aa" and got[6000] == "und"


def test_network_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    p = langid.train(x, rng.integers(0, 3, 40), 3)
    pooled = []
    for w in langid.WIDTHS:
        col = np.concatenate([p["embed"][x][:, j : j + langid.PLACES] for j in range(w)], axis=2)
        pooled.append((col @ p[f"filter{w}"]).max(axis=1) + p[f"bias{w}"])
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ p["out"] + p["out_bias"]
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(langid.Network(p).log_probabilities(x), want, atol=1e-4)
    g = langid._gradients(p, x, np.zeros(40, int))

    def loss(q):
        return -langid.Network(q).log_probabilities(x)[:, 0].sum(dtype=np.float64)

    for key, at in (("filter3", (2, 1)), ("embed", (int(x[0, 5]), 2)), ("out", (3, 0)), ("bias2", (0,))):
        assert 40 * g[key][at] == pytest.approx(numeric_gradient(loss, p, key, at, 1e-3), rel=0.1, abs=5e-3)


def slow_base(rows):
    words = {i: (r[1] or "").encode().lower().split() for i, r in enumerate(rows)}
    taught = [i for i, r in enumerate(rows) if r[0] is not None and not held(r[0], 10, 0)]
    count = Counter(w for i in taught for w in words[i])
    n, v = sum(count.values()) + len(taught), len(count) + bool(taught)
    out = []
    for i, r in enumerate(rows):
        c = [count[w] for w in words[i]] + [len(taught)]
        out.append((r[0], r[0] is None or held(r[0], 10, 0), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), 4)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [1 << 18, 100, 0])
def test_language_model_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "HELD_WORDS", 100)
    rows = awkward()
    got = lm.score_texts(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == slow_base(rows)
    assert all(r.score < 0 for r in got)


def test_language_model_is_better_than_the_unigram(spark):
    got = [r for r in lm.score_texts(docs(spark)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    gain = (sum(r.score for r in got) - sum(r.base_score for r in got)) / sum(r.n_tokens for r in got)
    print("log10 a token above the unigram", gain)


def small_vocabulary(n=400):
    words = [(f"w{i}".encode(), 1000 // (i + 1) + 1) for i in range(n)]
    shared = Counter()
    for w, c in words:
        shared[lm.shared_class(w) - lm.GROUPS] += c
    kinds = Counter(lm.shared_class(w) - lm.GROUPS for w, _ in words)
    total = sum(c for _, c in words)
    return lm.Vocabulary(words, {k: (shared[k], kinds[k]) for k in shared}, 50, total + 50, n + 1), words


def test_language_model_is_normalised(monkeypatch):
    monkeypatch.setattr(lm, "MODELLED", 300)
    v, words = small_vocabulary()
    model = lm.Model(v, lm.start_parameters(v))
    assert v.ids([b"w0", b"zz"]).tolist() == [0, 300 + lm.shared_class(b"zz") - lm.GROUPS, v.end()]
    for c1, c2 in ((0, 1), (v.end(), v.end()), (310, 250)):
        tokens = np.arange(v.end() + 1)  # modelled words, whole shared classes, the end
        p = 10.0 ** model.log10(np.full(len(tokens), c1), np.full(len(tokens), c2), tokens)
        assert p.sum() == pytest.approx(1, abs=1e-5)
    for k in range(lm.GROUPS, lm.END):  # words of a shared class, and one never seen, make up the class
        rest = [c for w, c in words if v.rank[w] >= v.n_words and lm.shared_class(w) == k]
        assert sum(c + lm.ALPHA for c in rest) + lm.ALPHA == pytest.approx(10 ** v.within[k])


def test_language_model_draws_by_share_and_learns(monkeypatch):
    v, _ = small_vocabulary()
    rng = np.random.default_rng(1)
    drawn = v.draw(np.full(20000, 3), rng)
    assert set(drawn.tolist()) == set(range(3, 400, lm.GROUPS))
    for w in range(3, 400, lm.GROUPS):
        assert (drawn == w).mean() == pytest.approx(v.share[w], abs=0.02)
    trainer = lm.Trainer(lm.start_parameters(v), v, 1)
    chain = np.tile([5, 196, 7, 300], 40000).astype(np.int32)  # 5 and 196 are of one group
    c1, c2 = lm.contexts(chain, v.end())
    for at in range(0, len(chain), lm.BATCH):
        trainer.step(c1[at : at + lm.BATCH], c2[at : at + lm.BATCH], chain[at : at + lm.BATCH])
    model = lm.Model(v, trainer.p)
    ask = lambda y: 10.0 ** model.log10(np.array([5]), np.array([300]), np.array([y]))[0]
    assert ask(196) > 0.5 and ask(196) > 20 * ask(5)


def test_language_model_scores_match_the_definition(spark):
    """score against softmaxes written out, a token at a time, with the parameters of one task."""
    rows = [r for r in awkward() if r[0] is not None and r[0] < 50]
    got = {r.doc_id: r.score for r in lm.score_texts(frame(spark, rows).coalesce(1)).collect()}
    words = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    taught = [d for d in words if not held(d, 10, 0)]
    count = Counter(w for d in taught for w in words[d])
    suffix = lambda k: [w for w in count if lm.shared_class(w) - lm.GROUPS == k]
    shared = {k: (sum(count[w] for w in suffix(k)), len(suffix(k))) for k in range(lm.SHARED) if suffix(k)}
    v = lm.Vocabulary(list(count.items()), shared, len(taught), sum(count.values()) + len(taught), len(count) + 1)
    trainer = lm.Trainer(lm.start_parameters(v), v, 7)
    ids = [v.ids(words[r[0]]) for r in rows if not held(r[0], 10, 0)]
    parts = [(*lm.contexts(i, v.end()), i) for i in ids]
    c1, c2, y = (np.concatenate(x) for x in zip(*parts))
    for at in range(0, len(y), lm.BATCH):
        trainer.step(c1[at : at + lm.BATCH], c2[at : at + lm.BATCH], y[at : at + lm.BATCH])
    p = {k: x.astype(float) for k, x in trainer.p.items()}
    for r in rows:
        ids = v.ids(words[r[0]])
        want = 0.0
        for i, token in enumerate(ids):
            a, b = (ids[i - k] if i >= k else v.end() for k in (1, 2))
            q = p["context"][a] @ p["mix1"] + p["context"][b] @ p["mix2"]
            z = np.exp(p["target"] @ q + p["bias"])
            k = v.class_of[token]
            want += math.log10(z[k] / z.sum())
            if token < v.n_words:
                group = range(k, v.n_words, lm.GROUPS)
                e = {w: math.exp(p["word"][w] @ q + p["word_bias"][w]) for w in group}
                want += math.log10(e[token] / sum(e.values()))
            elif token < v.end():
                want += math.log10((count[words[r[0]][i]] + lm.ALPHA) / 10 ** v.within[k])
        assert got[r[0]] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_shared_classes_agree_with_sql(spark):
    words = [b"a", b"ab", b"abc", "né".encode(), b"\xff", b"\x00\x01\x02"]
    df = spark.createDataFrame([(w,) for w in words], "word binary").select("word", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(lm.SHARED)).alias("k"))
    assert all(lm.shared_class(bytes(r.word)) == lm.GROUPS + r.k for r in df.collect())


def test_awkward_inputs(spark):
    rows = awkward()
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (1, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for table in (some, some.where("false")):
        for f in (quality_model.score_quality, toxicity.score_toxicity):
            got = f(frame(spark, rows), table).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert f(frame(spark, []), table).count() == 0
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (40, 41, 42)} == {"und"}
    for f in (langid.identify, lm.score_texts):
        assert f(frame(spark, [])).count() == 0
    nothing = langid.identify(frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
