"""Very many links among few nodes are contracted in their tasks; components with one start are not replayed."""

import itertools

import pytest

from kinweave.operators import components
from kinweave.streaming import resolver
from kinweave.workspace import Workspace
from tests.test_stream_resolver import line


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_many_edges_of_few_nodes_need_no_rounds(spark, monkeypatch, kind):
    def no_rounds(edges):
        raise AssertionError("a round of contraction")

    monkeypatch.setattr(components, "ONE_TASK", 500)
    monkeypatch.setattr(components, "_large_star", no_rounds)
    edges = [(100 * g + a, 100 * g + b) for g in (1, 2) for a, b in itertools.combinations(range(40), 2)]
    told = spark.createDataFrame(edges, "u long, v long").selectExpr(f"cast(u as {kind}) u", f"cast(v as {kind}) v")
    got = components.connected_components(told, Workspace(spark, "t")).collect()
    as_kind = str if kind == "string" else int
    assert {(r.node, r.component) for r in got} == {(as_kind(100 * g + a), as_kind(100 * g)) for g in (1, 2) for a in range(40)}


def test_rounds_after_the_forests(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 50)
    edges = [(i, i + 1) for i in range(120) if i != 60] + [(200, 200 + i) for i in range(1, 60)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0 if i <= 60 else 61) for i in range(121)} | {(200 + i, 200) for i in range(60)}


def test_components_with_one_start_are_not_replayed(spark, tmp_path, monkeypatch):
    def never(batches):
        for b in batches:
            if b.num_rows:
                raise AssertionError("replayed")
            yield b

    monkeypatch.setattr(resolver, "_replay", never)
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    people = [("A", "anand rao", "9845011123"), ("B", "anand rao", "9845011123"), ("C", "divya iyer", "9845022123")]
    for batch, hour in enumerate(("08", "09")):
        told = [(line(f"{i}{batch}", f"2026-01-01T{hour}:0{k}:00", name, phone, None),) for k, (i, name, phone) in enumerate(people)]
        resolver.resolve_batch(lake, batch, spark.createDataFrame(told, "raw string"))
    got = {r.record_id: (r.identity_id, r.action, r.matched_records, r.merged_identities) for r in resolver.state(spark, lake.path).outcomes.collect()}
    one, two = "PID0000001", "PID0000002"
    assert got == {
        "A0": (one, "new", 0, 0), "B0": (one, "joined", 1, 0), "A1": (one, "joined", 2, 0), "B1": (one, "joined", 3, 0), "C0": (two, "new", 0, 0), "C1": (two, "joined", 1, 0),
    }
