"""Questions answered from a few files, and reviews that replace earlier ones."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.plans import index, read, rings
from kinweave.sources import ledger
from tests.test_resolution import bridge_rows, rec, resolved, ring_rows


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    names = ["Anand Rao", "Divya Iyer", "Harish Nair", "Meena Khan", "Lakshmi Narayan"]
    rows = [rec(f"X{i:03d}", f"2026-01-{1 + i % 27:02d}T{i % 24:02d}:00:00", rng.choice(names), phone=f"98451{i % 90:05d}") for i in range(240)]
    return resolved(spark, bridge_rows() + ring_rows() + rows)


@pytest.fixture(scope="module")
def kept(spark, many, tmp_path_factory):
    out = index.Index(spark, f"file://{tmp_path_factory.mktemp('index')}")
    many_files = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as a large table has
    before = {k: spark.conf.get(k) for k in many_files}
    for k, v in many_files.items():
        spark.conf.set(k, v)
    out.save(many)
    for k, v in before.items():
        spark.conf.set(k, v)
    return out


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_views_are_those_over_all_tables(spark, many, kept):
    ids = [r.identity_id for r in many.identities.orderBy("identity_id").collect()]
    gone = many.identities.where("merged_into is not null").first()
    for i in (ids[5], gone.identity_id):
        for at in (None, "2026-03-01"):
            assert rows(kept.identity_view(i, at)) == rows(read.identity_view(many, i, at))
        assert rows(kept.history_view(i)) == rows(read.history_view(many, i))
        assert rows(kept.explain_view(i)) == rows(read.explain_view(many, i))
    assert rows(kept.record_view("A", "2026-02-01")) == rows(read.record_view(many, "A", "2026-02-01"))
    for q in ("Laxmi Narayan", "098450 11111", "K.Nair@mail.example", "Kavitha Nair"):
        got = rows(kept.smart_search(q))
        assert got == rows(read.smart_search(many, q)) and got
    for view in (kept.identity_view, kept.history_view, kept.explain_view, kept.record_view):
        with pytest.raises(read.NotFound):
            view("nobody")
    for q in ("", "  ", "x", "1234567890", "a@"):
        with pytest.raises(read.BadRequest):
            kept.smart_search(q)


def test_questions_read_a_few_files(spark, many, kept):
    all_files = len(kept.read("records").inputFiles()), len(kept.read("assignments").inputFiles())
    assert min(all_files) > 15
    about = kept.identity("PID0000001")
    assert len(about.assignments.inputFiles()) == 1 and len(about.identities.inputFiles()) == 1
    assert sum("/records/" in f for f in about.records.inputFiles()) <= about.assignments.count() <= 4
    plan = about.records._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_h" in plan or "PushedFilters: [EqualTo(_h" in plan or "EqualTo(_h" in plan


def test_saved_again_everything_is_replaced(spark, tmp_path):
    kept = index.Index(spark, f"file://{tmp_path}/index")
    kept.save(resolved(spark, bridge_rows()))
    kept.save(resolved(spark, bridge_rows()[:1]))
    assert kept.read("records").count() == 1 and kept.identity_view("PID0000001").first().record_count == 1
    with pytest.raises(read.NotFound):
        kept.identity_view("PID0000002")


def test_reviews_replace_and_one_is_left_after_compaction(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FANOUT", 2)
    kept = index.Index(spark, f"file://{tmp_path}/index")
    assert kept.report().count() == 0 and kept.overview().first().suspicious_total == 0
    kept.save(many)
    report = rings.ring_report(many, run_id="r1")
    kept.save_report(report, "r1")
    with pytest.raises(ValueError):
        kept.save_report(report, "r1")
    kept.review("r1", 1, "confirmed_fraud", None, "2026-02-01")
    kept.review("r1", 1, "false_alarm", f" seen {'x' * 600}", "2026-02-02")
    raw = [f[3] for run in kept.snapshot().runs["reviews"] for f in run.files]
    assert sum(raw) == 1  # rows that are stored
    row = kept.rings_view().where("component_id = 1").first()
    assert row.decision == "false_alarm" and len(row.note) == 500
    with pytest.raises(read.BadRequest):
        kept.review("r1", 1, "maybe", "", "2026-02-03")
    with pytest.raises(read.NotFound):
        kept.review("r1", 99, "false_alarm", "", "2026-02-03")
    detail = kept.ring_detail("r1", 1).first()
    assert detail.review.decision == "false_alarm" and len(detail.nodes) == report.where("component_id = 1").select(F.size("identity_ids")).first()[0]
    with pytest.raises(read.NotFound):
        kept.ring_detail("r1", 99)
    assert kept.overview().first().decisions == {"false_alarm": 1}
    kept.save_report(report.limit(0), "r2")
    assert kept.report().count() == 0 and kept.read("reviews").count() == 1
