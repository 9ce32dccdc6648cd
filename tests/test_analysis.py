"""Runs of the analysis, groups in detail, tables at rest, replay and the jobs."""

import json
from datetime import datetime

import pytest

from kinweave import jobs
from kinweave.plans import analysis, read, rings
from kinweave.sources import contracts, tables
from tests.test_resolution import rec, resolved

REVIEWS = "run_id string, component_id long, decision string, note string, reviewed_at string"


@pytest.fixture(scope="module")
def group(spark):
    names = ["Anand Rao", "Divya Iyer", "Harish Nair", "Meena Khan"]
    rows = [rec(f"E{i}", f"2026-01-0{i + 1}T10:00:00", n, email=f"p{i}@m.example", device="dev_1", source="ecommerce") for i, n in enumerate(names)]
    return resolved(spark, rows)


def test_runs_latest_and_detail(spark, group, tmp_path):
    folder = str(tmp_path / "reports")
    truth = spark.createDataFrame([(f"E{i}", f"P{i}", "", "R1") for i in range(4)], tables.TRUTH)
    old = analysis.run_analysis(group, folder, now=datetime(2026, 2, 1, 9))
    told = analysis.run_analysis(group, folder, truth, now=datetime(2026, 2, 1, 10))
    assert old["run_id"] == "run-20260201T090000" and told["components_reported"] == 1
    assert told["ring_detection"]["rings_flagged"] == 1 and told["matching_accuracy"]["precision"] == 1.0
    assert set(told["top_suspicious"][0]) == {"component_id", "label", "risk_score", "reasons", "features"}
    assert json.loads(analysis.as_json(told))["stats"]["records"] == 4
    reports = analysis.load_reports(spark, folder)
    report = analysis.latest_report(reports)
    assert {r.run_id for r in report.collect()} == {told["run_id"]} and reports.count() == 2
    none = spark.createDataFrame([], REVIEWS)
    assert analysis.open_suspicious(report, none).count() == 1
    reviews = spark.createDataFrame([(told["run_id"], 1, "false_alarm", "ok", "2026-02-02"), (told["run_id"], 1, "confirmed_fraud", "", "2026-02-01")], REVIEWS)
    assert analysis.open_suspicious(report, reviews).count() == 0
    row = analysis.ring_detail(group, report, reviews, told["run_id"], 1).first()
    assert [n.identity_id for n in row.nodes] == [f"PID000000{i}" for i in range(1, 5)] and len(row.edges) == 6
    assert all("device" in e.kinds for e in row.edges) and row.review.decision == "false_alarm"
    assert analysis.ring_detail(group, report, none, told["run_id"], 1).first().review is None
    with pytest.raises(read.NotFound):
        analysis.ring_detail(group, report, none, told["run_id"], 9)
    seen = read.overview(report, reviews).first()
    assert seen.label_counts == {"SUSPICIOUS_RING": 1} and seen.decisions == {"false_alarm": 1} and seen.suspicious_open == 0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        analysis.save_report(rings.ring_report(group), folder, told["run_id"], "2026-02-01T10:00:00")


def test_tables_at_rest(spark, group, tmp_path):
    with pytest.raises(ValueError):
        tables.Store(spark, "ftp://x")
    store = tables.Store(spark, f"parquet:{tmp_path}/store")
    assert store.health()["status"] == "error"
    store.create()
    assert store.health() == {"status": "ok"} and store.load().records.count() == 0
    store.save(group)
    got = store.load()
    assert sorted(got.links.collect()) == sorted(group.links.collect()) and got.records.count() == 4
    store.save_attributes(group)
    one = lambda attrs: [r.identity_id for r in read.smart_search(group, "divya iyer", attrs).collect()]
    assert one(store.attributes()) == one(None) == ["PID0000002"]
    path = tmp_path / "truth.csv"
    path.write_text("record_id,person_id,family_id,ring_id\nA,1,,\nB,2,F1,R1\nA,3,F2,\n")
    assert sorted(tuple(r) for r in tables.read_truth(spark, str(path)).collect()) == [("A", "3", "F2", ""), ("B", "2", "F1", "R1")]
    again = tables.to_json(group.records.select("record_id", "phones", "name_tokens"), ["phones", "name_tokens"])
    assert tables.from_json(again, ["phones", "name_tokens"]).where("record_id = 'E0'").first().name_tokens == ["anand", "rao"]
    bare = rings.identity_rows(resolved(spark, [rec("X", "2026-01-01T00:00:00", "")])).collect()
    assert len(bare) == 1 and bare[0].kind is None


def test_replay(spark, tmp_path):
    line = lambda i: json.dumps({"source": "telecom", "ingested_at": f"2026-01-0{i}", "payload": {"connection_id": f"T{i}", "msisdn": "9845012345", "subscriber_name": "a"}})
    lines = spark.createDataFrame([(f"2026-01-0{i}", line(i)) for i in (3, 1, 2, 4)], "at string, raw string")
    slept = []
    assert tables.replay(lines, str(tmp_path / "out"), rate=2, limit=3, step=2, clock=lambda: 0, sleep=slept.append) == 3
    assert slept == [1, 1.5] and {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {line(1), line(2), line(3)}
    found = {(r.topic, bytes(r.key).decode()) for r in tables.messages(lines.select("raw")).collect()}
    assert found == {("raw.telecom", f"T{i}") for i in range(1, 5)}


def test_jobs(spark, tmp_path, capsys):
    out = str(tmp_path)
    run = lambda *a: (jobs.main([*a], spark), json.loads(capsys.readouterr().out))[1]
    made = run("generate", out, "--persons", "40", "--rings", "1", "--seed", "3")
    assert made["rings"] == 1 and sum(made["by_source"].values()) == made["records"]
    arrived = [r.ingested_at for r in contracts.read_jsonl(spark, f"{out}/records").orderBy("arrival").collect()]
    assert arrived == sorted(arrived)
    told = run("resolve", out, f"parquet:{out}/store")
    assert sum(told["actions"].values()) == made["records"] and told["contract_errors"] == 0
    assert run("analyze", f"parquet:{out}/store", f"{out}/reports", "--truth", f"{out}/truth")["matching_accuracy"]["records"] == made["records"]


def test_duplicates_are_counted(spark):
    from kinweave.plans import resolve as res
    from tests.test_resolution import SCHEMA

    rows = [rec("A", "2026-01-01T00:00:00", "Anand Rao"), rec("A", "2026-01-02T00:00:00", "Anand Rao"), rec("B", "2026-01-03T00:00:00", "Divya Iyer")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.record_id, r.action) for r in res.all_outcomes(frame, res.resolve(frame)).collect())
    assert found == [("A", "duplicate"), ("A", "new"), ("B", "new")]
