"""Lines arrive in the order of the file, whatever their times say."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions.similarity import name_similarity
from kinweave.operators.normalize import blocking_keys
from kinweave.plans import resolve as res
from kinweave.sources import contracts
from kinweave.streaming import resolver
from tests.test_resolution import sequential


def told(seed, n):
    rng = random.Random(seed)
    names = [f"{a} {b}" for a in ("anand", "divya", "harish", "meena") for b in ("rao", "iyer")]
    rows = [(f"R{i:03d}", (datetime(2026, 1, 1) + timedelta(hours=i)).isoformat(), rng.choice(names), f"98450{rng.randrange(9):02d}123") for i in range(n)]
    rng.shuffle(rows)
    return rows


def line(row):
    i, at, name, phone = row
    return json.dumps({"source": "telecom", "ingested_at": at, "payload": {"connection_id": i, "msisdn": phone, "subscriber_name": name}})


def test_a_shuffled_file_in_many_blocks(spark, tmp_path):
    rows = told(4, 80)
    path = tmp_path / "lines"
    path.mkdir()
    (path / "b.jsonl").write_text("\n".join(map(line, rows[50:])) + "\n")
    (path / "a.jsonl").write_text("\n".join(map(line, rows[:50])) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        lines = contracts.read_jsonl(spark, str(path))
        assert lines.rdd.getNumPartitions() > 5
        canonical = contracts.canonical(contracts.validated(lines))
        assert [r.record_id for r in canonical.orderBy("arrival").collect()] == [r[0] for r in rows]
        r = res.resolve(canonical, Settings(block_cap=3))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    keys, byid = {}, {x[0]: x for x in rows}
    for x in blocking_keys(r.records).collect():
        keys.setdefault(x.record_id, []).append(x.key)

    def match(a, b):
        sim = name_similarity(byid[a][2].split(), byid[b][2].split())
        score = 3 * (sim >= 0.92) + 2 * (0.85 <= sim < 0.92) + (0.8 <= sim < 0.85) - 3 * (sim < 0.7) + 2.5 * (byid[a][3] == byid[b][3])
        return score >= 5 and round(sim, 3) >= 0.8

    want = sequential([(x[0], keys.get(x[0], [])) for x in rows], 3, match)
    assert {x.record_id: x.identity_id for x in r.assignments.where("valid_to is null").collect()} == want
    late = r.assignments.groupBy("record_id").agg(F.min("valid_from").alias("v")).join(r.records, "record_id").where("v < ingested_at")
    assert late.isEmpty() and "arrival" not in r.records.columns


def test_times_that_are_none(spark, tmp_path):
    values = [0, 0.0, False, [], {}, "", None, "0", 5, "not a time", "2026-01-01"]
    lines = [json.dumps({"source": "telecom", "ingested_at": v, "payload": {"connection_id": f"T{k}", "msisdn": "9845012345", "subscriber_name": "A B"}}) for k, v in enumerate(values)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, raw string")
    found = [r.error for r in contracts.validated(contracts.parse(df)).orderBy("k").collect()]
    assert found == ["missing ingested_at"] * 7 + [None] * 4
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    resolver.resolve_batch(lake, 0, df.select("raw"))
    errors = [json.loads(r.value)["error"] for r in lake.read("dead_letters").collect()]
    assert sorted(errors) == sorted(["missing ingested_at"] * 7 + [f"ingested_at is no time: '{v}'" for v in ("0", "5", "not a time")])
    assert [r.record_id for r in lake.read("records").collect()] == ["T10"]
