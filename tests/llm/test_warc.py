import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from kinweave.llm import warc
from kinweave.workspace import Workspace

PAGES = "page_id long, url string, html string"


def rows():
    big, other = "<p>ü</p>" * 200, "x" * 1000
    return [
        (1, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (3, "u", other), (4, "u", other), (5, "u", "y" * 999), (6, "u", "y" * 999),
        (7, None, None), (8, "u", ""), (10, "u", "a\r\n\r\nb"), (None, "u", big), (None, "u", "z" * 2000), (11, "u", "q" * 3_000_000), (11, "u", "q" * 3_000_000),
    ]


def expected(data):
    best, seen = {}, {}
    for i, _, h in data:
        p = (h or "").encode()
        if len(p) >= 1000:
            seen[p] = seen.get(p, 0) + 1
            best[p] = max([x for x in (best.get(p), i) if x is not None], default=None)
    out = []
    for i, _, h in data:
        p = (h or "").encode()
        to = best.get(p) if p in best and best[p] != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,most", [(1 << 26, 100), (500, -1)])
def test_round_trip(spark, monkeypatch, size, most):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    df = spark.createDataFrame(rows(), PAGES).withColumn("digest", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr) == expected(rows())
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(data):
    raw = io.BytesIO()
    with gzip.GzipFile(fileobj=raw, mode="wb") as out:
        for i, u, h in data:
            p = (h or "").encode()
            for part in warc.record(i, u, p, hashlib.sha1(p).hexdigest(), None):
                out.write(part)
            out.write(b"\r\n\r\n")
    return raw.getvalue()


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_normaliser_makes_members_that_add_up(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    data = rows()[:10]
    source, target, index = io.BytesIO(archive(data) + archive(data[:2])), io.BytesIO(), io.BytesIO()
    assert warc.normalise(source, target, index) == 12
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    out = target.getvalue()
    assert gzip.decompress(out) == gzip.decompress(source.getvalue())
    for e, (i, _, h) in zip(entries, data + data[:2]):
        page = warc._page(*warc._member(out[e["offset"] : e["offset"] + e["length"]]))
        assert page[0] == (None if i is None else str(i)) and page[2] == hashlib.sha1((h or "").encode()).hexdigest()


def test_damaged_archives_are_refused():
    good = archive(rows()[:2])
    for bad in (good[: len(good) // 2], gzip.compress(b"no record\r\n\r\n"), gzip.compress(gzip.decompress(good)[:-6])):
        with pytest.raises(Exception):
            if warc.normalise(io.BytesIO(bad), io.BytesIO(), io.BytesIO()) < 2:
                raise ValueError("records are missing")


def test_one_file_holds_one_gzip_stream(spark):
    from pyarrow import fs

    work = Workspace(spark, "t")
    made = warc.write_archives(spark.createDataFrame(rows(), PAGES).coalesce(1), work).first().archive
    where, name = fs.FileSystem.from_uri(f"{made}.warc.gz")
    data = where.open_input_stream(name, compression=None).read()
    assert data.count(b"\x1f\x8b\x08") >= 1 and gzip.decompress(data).count(b"WARC/1.1\r\n") == len(rows())


def test_text_ids(spark):
    named = [(x, "u", h) for x, (_, _, h) in zip(["", "a>b", "ü /%", "%", None, "~"], rows())]
    df = spark.createDataFrame(named, PAGES.replace("long", "string"))
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr) == expected(named)
