"""Queries with the resolver's block cap, against brute force over blocks larger than the cap."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from kinweave.config import SETTINGS
from kinweave.functions.similarity import name_similarity
from kinweave.operators.normalize import blocking_keys, normalized
from kinweave.plans import registry
from tests.test_resolution import SCHEMA, rec

FIRST, LAST = ["anand", "divya", "harish", "meena"], ["rao", "iyer", "nair"]


@pytest.fixture
def blocks(spark, monkeypatch):
    start = datetime(2026, 1, 1)
    rows = [
        rec(f"R{i:03d}", (start + timedelta(hours=i)).isoformat(), f"{FIRST[i % 4]} {LAST[i % 3]}", phone="9845011123" if i % 25 else "9845022123")
        for i in range(SETTINGS.block_cap + 30)
    ]
    recs = normalized(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(registry, "records", lambda spark, sf_dir: recs)
    found = defaultdict(list)
    for key, record in sorted((x.key, x.record_id) for x in blocking_keys(recs).collect()):  # ids are in order of arrival
        found[key].append(record)
    return {r[0]: r[3] for r in rows}, {k: v[: SETTINGS.block_cap + 1] for k, v in found.items()}


def test_whole_blocks(spark, blocks):
    names, members = blocks
    assert max(map(len, members.values())) > 200
    run = lambda name: registry.QUERIES[name](spark, "").collect()
    assert {(r.key, r.record_id, r["rank"]) for r in run("w1_block_rank")} == {(k, r, i) for k, v in members.items() for i, r in enumerate(v)}
    want = {(a, b) for v in members.values() for i, a in enumerate(v) for b in v[:i]}
    for name in ("j1_candidate_pairs", "m7_scored_pairs", "m5_m6_pair_features"):
        got = [(r.newer, r.older) for r in run(name)]
        assert len(got) == len(want) and set(got) == want, name
    for r in run("m7_scored_pairs"):
        assert r.name_similarity == pytest.approx(name_similarity(names[r.newer].split(), names[r.older].split()), abs=6e-4)
    assert {(r.a, r.b) for r in run("m1_jaro_winkler")} == {(x, y) for a, b in want for x in names[a].split() for y in names[b].split()}
