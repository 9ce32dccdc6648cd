"""Tables committed together, looked up by key, merged as they grow."""

import random

import pytest

from kinweave.sources import ledger
from kinweave.sources.ledger import Conflict, Kept, Ledger

TABLES = {
    "records": Kept("id string, v long", ("id",)),
    "current": Kept("id string, v long", ("id",), latest=True),
    "pairs": Kept("kind string, value string, n int", ("kind", "value")),
    "log": Kept("text string"),
}


def opened(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger", TABLES)


def put(spark, change, name, rows):
    return change.append(name, spark.createDataFrame(rows, TABLES[name].schema))


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nothing_is_seen_before_the_commit(spark, tmp_path):
    lake = opened(spark, tmp_path)
    assert lake.read("records").count() == 0 and lake.snapshot().lookup("current", keys(spark, "a")).count() == 0
    change = lake.begin()
    assert rows(put(spark, change, "records", [("a", 1)])) == [("a", 1)]
    put(spark, change, "log", [("x",), (None,)])
    assert lake.read("records").count() == 0
    change.facts["batch"] = 7
    now = change.commit()
    assert rows(lake.read("records")) == [("a", 1)] and lake.read("log").count() == 2
    assert (now.number, lake.snapshot().number, lake.snapshot().facts) == (1, 1, {"batch": 7})


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    lake = opened(spark, tmp_path)
    change = lake.begin()
    put(spark, change, "records", [("a", 1)])
    change.commit()
    dead = lake.begin()
    put(spark, dead, "records", [("b", 2)])  # and dies before "log"
    fs, path = lake._at("_commits/000000000002.json")
    stream = fs.create(path, False)
    stream.write(bytearray(b'{"facts": {}, "tab'))  # or in the middle of its commit
    stream.close()
    assert rows(lake.read("records")) == [("a", 1)] and lake.read("log").count() == 0
    again = lake.begin()
    put(spark, again, "records", [("b", 3)])
    assert again.commit().number == 3 and rows(lake.read("records")) == [("a", 1), ("b", 3)]
    assert lake.sweep() == 1 and lake.sweep() == 0
    assert rows(lake.read("records")) == [("a", 1), ("b", 3)]


def test_of_two_writers_one_commits(spark, tmp_path):
    lake = opened(spark, tmp_path)
    one, two = lake.begin(), lake.begin()
    for change, v in ((one, 1), (two, 2)):
        put(spark, change, "records", [("a", v)])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows(lake.read("records")) == [("a", 1)]


def test_newest_rows_and_lookups_after_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FANOUT", 3)
    monkeypatch.setattr(ledger, "ROWS_PER_FILE", 4)
    monkeypatch.setattr(ledger, "KEPT_COMMITS", 2)
    lake, rng = opened(spark, tmp_path), random.Random(1)
    want, pairs = {}, set()
    for batch in range(10):
        told = {f"k{rng.randrange(12)}": batch for _ in range(5)}
        want |= told
        change = lake.begin()
        put(spark, change, "current", list(told.items()))
        put(spark, change, "pairs", [(k, "x", batch) for k in told])
        pairs |= {(k, "x", batch) for k in told}
        change.commit()
    now = lake.snapshot()
    assert rows(now.read("current")) == sorted(want.items()) and rows(now.read("pairs")) == sorted(pairs)
    assert {r.level for r in now.runs["current"]} == {0, 2} and len(now.runs["current"]) == 2
    assert rows(now.lookup("current", keys(spark, "k1", "k1", "nobody", None))) == [("k1", want["k1"])]
    asked = spark.createDataFrame([("k1", "x"), ("k2", "y")], "kind string, value string")
    assert rows(now.lookup("pairs", asked)) == sorted(p for p in pairs if p[0] == "k1")
    assert len(lake._numbers()) == 2 and lake.sweep() == 0
    monkeypatch.setattr(ledger, "MOST_KEYS", 2)
    assert rows(now.lookup("current", keys(spark, "k1", "k2", "k3"))) == sorted((k, v) for k, v in want.items() if k in ("k1", "k2", "k3"))


def test_a_lookup_late_costs_what_one_costs_early(spark, tmp_path, monkeypatch):
    """The bytes of the files that batch 50 opens are about those of batch 5."""
    monkeypatch.setattr(ledger, "ROWS_PER_FILE", 50)
    lake, opened_bytes = opened(spark, tmp_path), {}
    for batch in range(1, 51):
        now = lake.snapshot()
        if batch in (5, 50):
            found = now.lookup("records", keys(spark, "k2-7"))
            assert rows(found) == [("k2-7", 2)]
            sizes = [fs.getFileStatus(path).getLen() for fs, path in (lake._at(f.split("/ledger/")[1]) for f in found.inputFiles())]
            opened_bytes[batch] = sum(sizes)
        change = lake.begin()
        put(spark, change, "records", [(f"k{batch}-{i}", batch) for i in range(40)])
        change.commit()
    assert lake.read("records").count() == 2000
    assert opened_bytes[50] <= 2 * opened_bytes[5]
