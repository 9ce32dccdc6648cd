"""Resolving batch by batch gives what one batch over all gives."""

import json
import random
from datetime import datetime, timedelta

import pytest

from kinweave.config import Settings
from kinweave.plans import read, resolve as res
from kinweave.sources import contracts
from kinweave.streaming import ingest, resolver


def line(i, at, name, phone, email):
    if email is None:
        body = {"source": "telecom", "payload": {"connection_id": i, "msisdn": phone, "subscriber_name": name}}
    else:
        body = {"source": "ecommerce", "payload": {"customer_id": i, "display_name": name, "email": email, "phone": phone}}
    return json.dumps({**body, "ingested_at": at})


def lines(seed, n):
    rng, start = random.Random(seed), datetime(2026, 1, 1)
    first, last = ["anand", "divya", "harish", "meena"], ["rao", "iyer"]
    return [
        line(f"R{i:03d}", (start + timedelta(hours=i)).isoformat(), f"{rng.choice(first)} {rng.choice(last)}", f"98450{rng.randrange(12):02d}123",
             f"u{rng.randrange(25)}@m.example" if rng.random() < 0.6 else None)
        for i in range(n)
    ]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("cap", [2, 200])
def test_batches_equal_one_batch(spark, tmp_path, cap):
    told = lines(5, 60)
    s = Settings(block_cap=cap)
    whole = res.resolve(contracts.canonical(contracts.validated(contracts.parse(spark.createDataFrame([(x,) for x in told], "raw string")))), s)
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    cuts = [0, 25, 26, 60]
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = told[lo:hi] + (told[:2] + ["nonsense"] if b == 1 else [])
        part = spark.createDataFrame([(x,) for x in part], "raw string")
        for _ in range(2 if b == 1 else 1):  # runs again after a crash
            resolver.resolve_batch(lake, b, part, s)
    got = resolver.state(spark, lake.path)
    for name in ("records", "links", "assignments", "identities"):
        assert rows(getattr(got, name)) == rows(getattr(whole, name)), name
    assert rows(got.outcomes.where("action <> 'duplicate'")) == rows(whole.outcomes)
    now = {r.record_id: r.identity_id for r in got.assignments.where("valid_to is null").collect()}
    again = got.outcomes.where("action = 'duplicate'").collect()
    assert {r.record_id for r in again} == {"R000", "R001"} and len(again) == 2 and all(r.identity_id for r in again)
    counts = resolver.totals(spark, lake.path).first()
    assert (counts.lines, counts.dead_lettered, counts.duplicate, counts.new + counts.joined + counts.merged) == (63, 1, 2, 60)
    assert (counts.skipped_hub_blocks > 0) == (cap == 2) and len(now) == 60
    assert read.stats(got).first().records == 60


def test_stream_from_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n".join(lines(6, 12)[6 * k : 6 * k + 6]))
    query = resolver.start(ingest.folder_lines(spark, str(folder), 1), str(tmp_path / "lake"), str(tmp_path / "check"))
    query.awaitTermination()
    assert resolver.totals(spark, str(tmp_path / "lake")).first().lines == 12
    assert resolver.state(spark, str(tmp_path / "lake")).assignments.where("valid_to is null").count() == 12
    told = resolver.progress(query)
    assert told is None or told["lag"] == 0


def test_of_equal_identities_the_lower_number_survives():
    for few, many in (("PID9999999", "PID10000000"), ("PID0000002", "PID0000010")):
        rows = [("R:x", datetime(2026, 1, 1), [f"I:{many}", f"I:{few}"], 2)]
        told = list(resolver.replay_batch(rows, {f"I:{many}": 3, f"I:{few}": 3}))
        assert [t[4] for t in told if t[0] == "merged"] == [f"I:{few}"] and [t[5] for t in told if t[0] == "end"] == [f"I:{many}"]


def test_a_batch_that_dies_between_two_tables(spark, tmp_path, monkeypatch):
    """Readers see the state before it, and the batch that runs again gives what it would have given."""
    told = lines(9, 24)
    batch = lambda lo, hi: spark.createDataFrame([(x,) for x in told[lo:hi]], "raw string")
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    resolver.resolve_batch(lake, 0, batch(0, 12))
    before = {name: rows(lake.read(name)) for name in resolver.TABLES}
    append = resolver.Change.append

    def dies(change, name, df):
        if name == "moves":
            raise RuntimeError("lost")
        return append(change, name, df)

    monkeypatch.setattr(resolver.Change, "append", dies)
    with pytest.raises(RuntimeError):
        resolver.resolve_batch(lake, 1, batch(12, 24))
    assert {name: rows(lake.read(name)) for name in resolver.TABLES} == before
    monkeypatch.setattr(resolver.Change, "append", append)
    resolver.resolve_batch(lake, 1, batch(12, 24))
    after = {name: rows(lake.read(name)) for name in resolver.TABLES}
    resolver.resolve_batch(lake, 1, batch(12, 24))  # delivered again after the commit
    assert {name: rows(lake.read(name)) for name in resolver.TABLES} == after
    whole = res.resolve(contracts.canonical(contracts.validated(contracts.parse(batch(0, 24)))))
    assert rows(resolver.state(spark, lake.path).assignments) == rows(whole.assignments)
    assert lake.sweep() > 0
