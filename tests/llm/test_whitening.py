"""Whitened vectors against exact sums and a plain eigenvalue problem."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, whitened string, _id string, _vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def usable(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def slow(rows, most=8):
    """Rows in exact arithmetic as far as the eigenvectors allow."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(d)]
    centred = np.array([[float(Fraction(v[k]) - Fraction(sums[k], n)) for k in range(d)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    return {(i, c + 1): (sum((n * a - s) ** 2 for a, s in zip(v, sums)), white[r, c], values[order[c]] / np.trace(cov)) for r, ((i, _), v) in enumerate(zip(rows, x)) for c in range(len(order))}


def check(got, rows, most=8):
    want = slow(rows, most)
    assert len(got) == len(want)
    signs = {}
    for r in got:
        deviation, white, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (len(rows), deviation)
        assert r.explained == pytest.approx(share, rel=1e-6)
        assert r.identity_error <= 1e-6
        signs.setdefault(r.component, []).append((r.whitened, white))
    for pairs in signs.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def made(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, list(v)) for i, v in enumerate((rng.normal(size=(n, d)) * np.linspace(2, 0.5, d)).astype(np.float32).tolist())]


def test_rows_that_do_not_count(spark):
    rows = made(200, 12)
    odd = [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] + [0.0] * 11), (1004, [0.0] * 11 + [float("-inf")]), (1005, [1.0] * 3), (1006, [1e30] * 12)]
    check(whitening.whiten(frame(spark, rows + odd)).collect(), usable(rows, 12))


def test_few_dimensions_and_repeated_rows(spark):
    rows = made(50, 3)
    got = whitening.whiten(frame(spark, rows + rows + [(None, rows[0][1])])).collect()
    assert len(got) == 101 * 3 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {101}
    assert sum(r.vec_id is None for r in got) == 3


def test_no_variance_and_no_rows(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)}
    flat = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.75, 0.25]), (3, [0.5, 0.25])])).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.whitened is not None for r in flat if r.component == 1)
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_blocks_and_large_entries(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 20)
    rows = [(i, [c * 3e2 for c in v]) for i, v in made(60, 6, 3)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    x = np.array([[2**61, -(2**61)], [0, 5]])
    assert whitening._exact_sum(np.repeat(x, 8, 0)) == [2**64, -(2**64) + 40]
    assert whitening.squared_deviation(np.array([[3, 5]]), 2**40, [1, 2]) == [None]
    assert whitening.squared_deviation(np.array([[3, 5]]), 2**20, [1, 2]) == [(3 * 2**20 - 1) ** 2 + (5 * 2**20 - 2) ** 2]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = whitening.op13_whitening(spark, "/root/testdata/sf0.001")
    check(got.collect(), usable(rows, 64))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.agg(F.count_distinct("identity_error")).first()[0] == 1
