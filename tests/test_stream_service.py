"""Metrics of a running stream, and its end after the batch in work."""

import os
import signal
import threading
import time

import pytest

from kinweave.streaming import ingest, resolver
from tests.test_stream_resolver import lines


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "in"
    out.mkdir()
    told = lines(6, 18)
    for k in range(3):
        (out / f"{k}.jsonl").write_text("\n".join(told[6 * k : 6 * k + 6] + ["nonsense"] * (k == 1)))
        os.utime(out / f"{k}.jsonl", (k + 1, k + 1))
    return str(out)


def test_rows_of_three_batches(spark, tmp_path, folder):
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    meter = resolver.Meter(lake, every=0)
    spark.streams.addListener(meter)
    try:
        resolver.start(ingest.folder_lines(spark, folder, 1), lake.path, str(tmp_path / "check")).awaitTermination()
        for _ in range(100):  # events come after the batches
            if meter.batch == 2 and meter.told == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(meter)
    rows = resolver.metered(spark, lake.path).orderBy("at").collect()
    want = resolver.totals(spark, lake.path).first().asDict()
    assert rows[-1].totals == want and want["lines"] == 19 and want["dead_lettered"] == 1
    assert sum(r.lines for r in rows) == 19 and {r.batch for r in rows if r.lines} <= {0, 1, 2}
    assert all(r.lag == 0 and r.rate == pytest.approx(r.lines / r.seconds) for r in rows if r.seconds > 0)


def test_a_window_of_ten_seconds(spark, tmp_path):
    now = [100.0]
    lake = resolver.Lake(spark, str(tmp_path / "lake"))
    meter = resolver.Meter(lake, clock=lambda: now[0])
    for at in (104.0, 109.9, 110.0, 115.0):
        now[0] = at
        meter.onQueryIdle(None)
    assert [(r.seconds, r.lines) for r in resolver.metered(spark, lake.path).collect()] == [(10.0, 0)]


def test_lag_is_what_the_topics_still_hold():
    source = {"endOffset": '{"raw": {"0": 5, "1": 7}}', "latestOffset": {"raw": {"0": 9, "1": 7, "2": 3}}}
    assert resolver._waiting([source, {"endOffset": None, "latestOffset": "x"}]) == 7


def test_sigterm_ends_after_the_batch_in_work(spark, tmp_path, folder, monkeypatch):
    lake, begun = resolver.Lake(spark, str(tmp_path / "lake")), []
    resolve_batch = resolver.resolve_batch

    def slow(lake, batch, rows, s):
        begun.append(batch)
        if len(begun) == 1:
            os.kill(os.getpid(), signal.SIGTERM)
            time.sleep(2)
        resolve_batch(lake, batch, rows, s)

    monkeypatch.setattr(resolver, "resolve_batch", slow)
    stopping = resolver.Stopping()
    query = resolver.start(ingest.folder_lines(spark, folder, 1), lake.path, str(tmp_path / "check"), stopping=stopping)
    resolver.serve(query, stopping)
    assert not query.isActive and begun == [0] and lake.snapshot().facts["batch"] == 0
    assert resolver.totals(spark, lake.path).first().lines == 6
    assert signal.getsignal(signal.SIGTERM) == signal.SIG_DFL and threading.current_thread() is threading.main_thread()
    again = resolver.Stopping()
    resolver.serve(resolver.start(ingest.folder_lines(spark, folder, 1), lake.path, str(tmp_path / "check"), stopping=again), again)
    assert resolver.totals(spark, lake.path).first().lines == 19 and lake.snapshot().facts["batch"] == 2
