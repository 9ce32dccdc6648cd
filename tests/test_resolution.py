"""The batch plan against a sequential model, views in time, contracts, rings, streaming."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions.similarity import name_similarity
from kinweave.operators.components import connected_components
from kinweave.plans import evaluate, read, resolve as res, rings
from kinweave.sources import contracts
from kinweave.streaming import ingest
from kinweave.workspace import Workspace

SCHEMA = (
    "record_id string, source string, ingested_at string, name string, dob string, address string, pincode string, "
    "gov_id string, email string, device_id string, phones array<string>, unexpected_fields array<string>"
)


def rec(i, at, name, phone=None, email=None, dob=None, address=None, gov=None, device=None, source="telecom"):
    return (i, source, at, name, dob, address, None, gov, email, device, [phone] if phone else [], [])


def resolved(spark, rows, **settings):
    return res.resolve(spark.createDataFrame(rows, SCHEMA), Settings(**settings))


def bridge_rows():
    return [
        rec("A", "2026-01-05T10:00:00", "Kavitha Nair", phone="9845011111"),
        rec("B", "2026-02-05T10:00:00", "Kavitha Nair", email="k.nair@mail.example", source="ecommerce"),
        rec("C", "2026-03-05T10:00:00", "Kavitha Nair", phone="9845011111", email="k.nair@mail.example", source="ecommerce"),
    ]


def test_bridge_merges_and_history_remembers(spark):
    r = resolved(spark, bridge_rows())
    assert {(x.record_id, x.action) for x in r.outcomes.collect()} == {("A", "new"), ("B", "new"), ("C", "merged")}
    assert read.identity_view(r, "PID0000001").first().record_count == 3
    before = read.identity_view(r, "PID0000001", "2026-03-01").first()
    assert (before.record_count, before.status) == (1, "active")
    gone = read.identity_view(r, "PID0000002").first()
    assert (gone.record_count, gone.status, gone.merged_into) == (0, "merged", "PID0000001")
    assert read.identity_view(r, "PID0000002", "2026-03-01T00:00:00+05:30").first().status == "active"
    assert [x.reason for x in read.history_view(r, "PID0000001").collect()] == ["no matching records", "merged from PID0000002", "bridged 2 identities via 2 matching record(s)"]
    assert read.explain_view(r, "PID0000001").count() == 2
    assert read.record_view(r, "B", "2026-02-10").first().identity_id == "PID0000002"
    with pytest.raises(read.NotFound):
        read.identity_view(r, "PID0000002", "2026-01-10")
    with pytest.raises(read.NotFound):
        read.identity_view(r, "PID0000009")
    with pytest.raises(read.BadRequest):
        read.identity_view(r, "PID0000001", "yesterday")


def test_family_and_conflicts_stay_apart(spark):
    rows = [
        rec("A", "2026-01-01", "Ramesh Sharma", phone="9845022222", address="12 lake road"),
        rec("B", "2026-01-02", "Rahul Sharma", phone="9845022222", address="12 lake road"),
        rec("C", "2026-01-03", "Ramesh Sharma", phone="9845033333", dob="1990-01-01"),
        rec("D", "2026-01-04", "Ramesh Sharma", phone="9845033333", dob="1980-05-05"),
    ]
    assert resolved(spark, rows).links.count() == 0


def test_swapped_birth_date_is_evidence(spark):
    rows = [rec("A", "2026-01-01", "Anand Rao", phone="9845044444", dob="1990-03-07"), rec("B", "2026-01-02", "Aanand Rao", phone="9845044444", dob="1990-07-03")]
    link = resolved(spark, rows).links.first()
    assert any("swapped" in x for x in link.reasons) and (link.record_a, link.record_b) == ("A", "B")


def test_redelivery_counts_once(spark):
    rows = [rec("A", "2026-01-02", "Anand Rao"), rec("A", "2026-01-01", "Anand Rao", source="ecommerce")]
    r = resolved(spark, rows)
    assert r.records.count() == 1 and r.records.first().source == "ecommerce"


def test_empty(spark):
    r = resolved(spark, [])
    assert r.assignments.count() == 0 and r.identities.count() == 0


def sequential(rows, cap, match):
    """The resolver as one loop over records in arrival order."""
    blocks, holder, members, number, ids = {}, {}, {}, 0, {}
    for key, keys in rows:
        near = set()
        for k in keys:
            if len(blocks.get(k, [])) <= cap:
                near |= set(blocks.get(k, []))
        hit = [o for o in near if match(key, o)]
        touched = sorted({holder[o] for o in hit}, key=lambda p: (-len(members[p]), p))
        if not touched:
            number += 1
            touched = [number]
            members[number] = set()
        for gone in touched[1:]:
            for m in members.pop(gone):
                holder[m] = touched[0]
                members[touched[0]].add(m)
        holder[key] = touched[0]
        members[touched[0]].add(key)
        for k in keys:
            blocks.setdefault(k, []).append(key)
    return {k: f"PID{v:07d}" for k, v in holder.items()}


@pytest.mark.parametrize("seed,cap", [(1, 0), (2, 1), (3, 3), (4, 200)])
def test_batch_equals_sequential(spark, seed, cap):
    rng = random.Random(seed)
    first, last = ["anand", "divya", "harish", "meena"], ["rao", "iyer"]
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(70):
        n = f"{rng.choice(first)} {rng.choice(last)}"
        rows.append(rec(f"R{i:03d}", (start + timedelta(hours=i)).isoformat(), n, phone=f"98450{rng.randrange(12):02d}123", email=f"u{rng.randrange(25)}@m.example" if rng.random() < 0.6 else None))
    r = resolved(spark, rows, block_cap=cap)
    from kinweave.operators.normalize import blocking_keys

    keys = {}
    for x in blocking_keys(r.records).collect():
        keys.setdefault(x.record_id, []).append(x.key)
    byid = {x[0]: x for x in rows}

    def match(a, b):
        p, q = byid[a], byid[b]
        sim = name_similarity(p[3].split(), q[3].split())
        score = 3 * (sim >= 0.92) + 2 * (0.85 <= sim < 0.92) + (0.8 <= sim < 0.85) - 3 * (sim < 0.7)
        return score + 2.5 * (p[10] == q[10]) + 4 * (p[8] is not None and p[8] == q[8]) >= 5 and round(sim, 3) >= 0.8

    want = sequential([(x[0], keys.get(x[0], [])) for x in rows], cap, match)
    got = {x.record_id: x.identity_id for x in r.assignments.where("valid_to is null").collect()}
    assert got == want


def test_history_clamps_late_events(spark):
    rows = [("r", datetime(2026, 1, d), i, str(i), f"P{i}") for i, d in enumerate([5, 3, 9])]
    got = res.history(spark.createDataFrame(rows, "record_id string, at timestamp_ntz, trigger_at int, trigger string, identity_id string")).orderBy("trigger_at").collect()
    assert [(x.valid_from.day, x.valid_to and x.valid_to.day) for x in got] == [(5, 5), (5, 9), (9, None)]


def test_contract_messages(spark):
    lines = [
        {"source": "telecom", "ingested_at": "2026-01-01", "payload": {"connection_id": "T1", "mobile_number": "1", "subscriber_name": "A"}},
        {"source": "crm", "ingested_at": "x", "payload": {}},
        {"source": "telecom", "ingested_at": "", "payload": {}},
        {"source": "telecom", "ingested_at": "x", "payload": [1]},
        {"source": "telecom", "ingested_at": "x", "payload": {"connection_id": "T1", "msisdn": " ", "subscriber_name": "A"}},
        {"source": "telecom", "ingested_at": "x", "payload": {"connection_id": "T1", "msisdn": "9845012345", "subscriber_name": "A", "plan": "p"}},
    ]
    df = contracts.parse(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "i int, raw string"))
    found = contracts.validated(df).orderBy("i").collect()
    assert [x.error for x in found] == [
        "telecom: missing required field(s) ['msisdn']; unexpected field(s) ['mobile_number'] - possible schema drift",
        "unknown source: 'crm'", "missing ingested_at", "payload must be an object",
        "telecom: field 'msisdn' must be a non-empty string", None,
    ]
    assert contracts.canonical(contracts.validated(df)).first().unexpected_fields == ["plan"]


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 50)] + [("x", "x")]
    got = connected_components(spark.createDataFrame(edges, "u string, v string"), Workspace(spark, "t")).collect()
    assert {(x.node[0], x.component) for x in got} == {("n", "n000"), ("s", "s000")} and len(got) == 111


def ring_rows():
    names = ["Anand Rao", "Divya Iyer", "Suresh Khan", "Meena Das"]
    return [rec(f"E{i}", f"2026-01-0{i + 1}", n, email=f"e{i}@m.example", device="dev_x", address="9 hill road", source="ecommerce") for i, n in enumerate(names)]


def test_rings_reviews_overview(spark):
    r = resolved(spark, ring_rows())
    report = rings.ring_report(r)
    row = report.first()
    assert row.label == "SUSPICIOUS_RING" and row.features.size == 4 and row.component_id == 1
    edges = rings.shared_edges(report, rings.identity_attributes(r)).collect()
    assert len(edges) == 6 and all("device" in e.kinds for e in edges)
    a = read.checked_review(report, "run", 1, "confirmed_fraud", " x ", "2026-02-01")
    b = read.checked_review(report, "run", 1, "false_alarm", "", "2026-02-02")
    assert read.rings_view(report, a.union(b), "suspicious_ring").first().decision == "false_alarm"
    seen = read.overview(report, a.union(b)).first()
    assert (seen.suspicious_total, seen.suspicious_open, seen.decisions) == (1, 0, {"false_alarm": 1})
    with pytest.raises(read.BadRequest):
        read.checked_review(report, "run", 1, "maybe", "", "x")
    with pytest.raises(read.NotFound):
        read.checked_review(report, "run", 7, "false_alarm", "", "x")
    truth = spark.createDataFrame([(f"E{i}", f"p{i}", "", "R1") for i in range(4)], "record_id string, person_id string, family_id string, ring_id string")
    got = rings.evaluate_rings(report, r.assignments, truth).first()
    assert (got.planted_rings, got.rings_flagged, got.ring_recall) == (1, 1, 1.0)
    m = evaluate.pairwise_metrics(r.assignments, truth).first()
    assert (m.records, m.precision, m.recall) == (4, 1.0, 1.0)


def test_search_and_activity(spark):
    rows = [rec("A", "2026-01-01", "Lakshmi Narayan", phone="9845012345"), rec("B", "2026-01-02", "Laxmi Narayan", phone="9845012345"), rec("C", "2026-01-03", "laksmi_narayan", phone="+91 98450 12345")]
    r = resolved(spark, rows)
    hit = read.smart_search(r, "Laxmi Narayan").collect()
    assert len(hit) == 1 and hit[0].record_count == 3
    assert read.smart_search(r, "098450 12345").count() == 1
    assert read.public_records(r.records).first().phones[0].endswith("******2345")
    with pytest.raises(read.BadRequest):
        read.search(r, name="x")
    assert [x.record_id for x in read.activity(r, 2)[0].collect()] == ["C", "B"]
    assert read.stats(r).first().records == 3


def test_streaming_is_idempotent(spark, tmp_path):
    lines, lake, mark = tmp_path / "in", tmp_path / "lake", tmp_path / "mark"
    lines.mkdir()

    def send(name, *items):
        (lines / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items))

    def message(i):
        return {"source": "telecom", "ingested_at": f"2026-01-0{i}", "payload": {"connection_id": f"T{i}", "msisdn": "9845012345", "subscriber_name": "Anand Rao"}}

    def go():
        query = ingest.start(ingest.folder_lines(spark, str(lines)), str(lake), str(mark))
        query.awaitTermination(120)
        assert query.exception() is None

    send("1.jsonl", message(1), message(1), "not json", "[1, 2]", {"source": "crm"})
    go()
    send("2.jsonl", message(1), message(2))
    go()
    like = contracts.canonical(contracts.validated(spark.createDataFrame([], contracts.ENVELOPE)))
    got = ingest.records(spark, str(lake), like)
    assert sorted(x.record_id for x in got.collect()) == ["T1", "T2"]
    letters = spark.read.option("recursiveFileLookup", "true").text(str(lake / "dead_letters")).collect()
    assert sorted(json.loads(x.value)["error"] for x in letters) == ["not a JSON object", "not a JSON object", "unknown source: 'crm'"]
    assert res.resolve(got).identities.count() == 1
