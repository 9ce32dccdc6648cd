import random
import sys
from collections import Counter

import pytest

import corpus_pipeline as cp
from kinweave.llm import decontaminate
from tests.llm.cases import SCHEMA, awkward, frame, sentence
from tests.llm.test_dedup import slow_removal
from tests.llm.test_similar import alike, as_set

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, f) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, DATA).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def as_rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == cp.COLUMNS and dict(after.dtypes) == dict(before.dtypes)
    assert steps[-1][1].columns == [*cp.COLUMNS, "tokens", "rate", "copies"]


def test_near_copies_keep_the_least_of_each_group(steps):
    before, after = (as_rows(x) for x in steps[1])
    sets = {d: as_set(t) for d, t, *_ in before}
    ids, kept = sorted(sets), {r[0] for r in after}
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if alike(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert kept == {root(i) for i in ids}


def test_an_id_with_two_texts_is_two_documents(spark, tmp_path):
    rng = random.Random(8)
    item = sentence(rng, 40)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (1, b, "en", "a", 1), (2, a, "en", "a", 1), (3, f"{b} {item}", "en", "a", 1), (3, a[::-1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.text for r in cp.near_copies(spark, docs, "").collect()) == sorted([a, b, f"{b} {item}", a[::-1]])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = cp.benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in left if r.doc_id == 3) == [a[::-1]] and len(left) == 5


def test_repeated_passages_match_brute_force(steps):
    before, after = (as_rows(x) for x in steps[2])
    texts = {r[0]: r[1] for r in before}
    want = {}
    for d, n, gone, kept in slow_removal(before, 35):
        if not gone or gone < n:
            want[d] = kept if gone else texts[d]
    assert {r[0]: r[1] for r in after} == want
    assert all(r[4] == len(r[1]) for r in after)


def test_leaks_go_and_the_rest_stays(spark, steps):
    before, after = (as_rows(x) for x in steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = Counter(w for _, text in items for w in set(decontaminate.tokens(text)))
    seeds = decontaminate.Seeds(items, found, max(2, int(0.01 * len(items))), 3)
    assert {r[0] for r in after} == {r[0] for r in before if not seeds.matches(r[1], 0.5, 8)}


def test_rules_and_mixture(steps):
    before, after = (as_rows(x) for x in steps[0])
    assert 0.75 * len(before) < len(after) < len(before) and set(after) <= set(before)
    before, after = steps[4]
    assert after.count() == before.count() and after.where("rate <= 0").count() == 0


def test_run_equals_the_stages(spark, steps):
    assert sorted(as_rows(cp.run(spark, DATA))) == sorted(as_rows(steps[-1][1]))


def test_awkward_and_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (awkward(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, f in cp.STAGES:
            out = f(spark, docs, str(tmp_path))
            assert out.columns[:5] == cp.COLUMNS, name
            if name.startswith("SimHash"):
                found = [(r.doc_id, r.text) for r in out.collect()]
                assert len(found) == len(set(found))
            else:
                assert out.count() <= len(rows)
    assert frame and sys
