"""Token ids and texts as the tokenizers library has them."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import bpe
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


def texts(seed, n):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32, 10, 39, 0x85, 0x3000]))
    odd = ["".join(pick() for _ in range(rng.randrange(40))) for _ in range(n)]
    return odd + ["", " ", "x" * 5000, "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "I'll we've 'RE \n\n  x\t ", "don't  stop  ", "🙂🙂 漢字かな 123abc"]


def test_ids_are_those_of_the_library(library, vocabulary):
    for text in texts(1, 3000):
        assert vocabulary.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_every_code_point_is_in_the_librarys_class(library, vocabulary):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    told = ["".join(f"{c}a1. {c}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    for text, want in zip(told, library.encode_batch(told, add_special_tokens=False)):
        assert vocabulary.encode(text) == np.array(want.ids, "<u4").tobytes()


def test_long_texts_go_in_steps(library, vocabulary, monkeypatch):
    text = " ".join(texts(2, 400))
    monkeypatch.setattr(bpe, "STEP", 50)
    monkeypatch.setattr(bpe, "KEPT", 20)
    assert vocabulary.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_any_ids_decode_as_the_library_does(library, vocabulary):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(12))]
        assert vocabulary.decode(np.array(ids, int)) == library.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode(np.array([-1, 32, 60_000])) == library.decode([32])


def test_awkward_rows(spark, library):
    rows = awkward()
    got = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH).collect()
    key = lambda i, t: (i is not None, i or 0, t)
    want = sorted((key(r[0], r[1] or ""), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((key(r.doc_id, r.decoded), r.ids) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, None, 72]), (4, [-5, 72])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, PATH).orderBy("k").collect()] == ["", "", "ii", "i"]
    assert bpe.encode(frame(spark, []), PATH).count() == 0


def test_slices_of_a_batch(spark, monkeypatch, library):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(4, 50))], "doc_id long, text string").coalesce(1)
    got = bpe.decode(bpe.encode(rows, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == texts(4, 50)


def test_other_tokenizers_are_refused(spark):
    with pytest.raises((ValueError, KeyError)):
        bpe.encode(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = bpe.op11_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
