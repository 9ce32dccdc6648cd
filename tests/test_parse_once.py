"""A line's payload is parsed once, and fields that are no text are listed."""

import json

from kinweave.sources import contracts


def test_payload_is_parsed_once(spark):
    bodies = [
        {"connection_id": 7, "msisdn": "1", "subscriber_name": ["x"], "circle": None, "other": 3}, {"connection_id": "7", "msisdn": "1", "subscriber_name": "x"}, "text", None,
    ]
    lines = [json.dumps({"source": "telecom", "ingested_at": "2026-01-01", "payload": b}) for b in bodies] + ["nonsense", '{"payload": {"msisdn": 1']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, raw string")
    rows = contracts.parse(df)
    other = rows.select("not_text")
    assert other._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
    got = {r.k: r.not_text and sorted(r.not_text) for r in rows.collect()}
    assert got[0] == ["circle", "connection_id", "subscriber_name"] and got[1] == [] and got[2] is None and got[3] is None and got[4] is None
