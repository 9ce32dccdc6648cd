"""One text longer than the chunks in which texts are handled."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, langid, quality_model, quality_rules, simhash, substrings, toxicity
from kinweave.llm.bytetok import CHUNK_BYTES
from tests.llm.cases import SCHEMA, sentence
from tests.llm.test_dedup import slow_fingerprint, slow_removal
from tests.llm.test_rules import slow_counts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    long = sentence(rng, 200_000)
    passage = " ".join(long.split()[100_000:100_050])
    return [(1, long, "en", "a", len(long)), (2, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}", "en", "a", 1), (3, sentence(rng, 60) + ".", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    assert len(rows[0][1]) > CHUNK_BYTES
    return spark.createDataFrame(rows, SCHEMA)


def test_fingerprint_and_substrings(docs, rows):
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: f"{slow_fingerprint(t):016x}" for d, t, *_ in rows}
    cut = substrings.remove_repeated(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in cut) == slow_removal(rows, 35)


def test_rules_and_leaks(spark, docs, rows):
    got = quality_rules.quality_rules(docs).where("doc_id = 1").first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == slow_counts(rows[0][1])
    item = " ".join(rows[0][1].split()[150_000:150_040])
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score, r.end_word) for r in found] == [(1, 7, 1.0, 150_040)]


def test_models_score_the_whole(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality_model.score_quality, toxicity.score_toxicity):
        assert all(0 <= r.score <= 1 for r in f(docs, labels).collect())
    assert langid.identify(docs).where(F.col("doc_id") == 1).first().lang_pred == "en"
