"""WARC archives: writing them as one gzip stream, normalising them, reading them back.

The normaliser takes an archive that was compressed as a whole, inflates it once from start
to end, and writes every record again as a gzip member of its own, with an index of offsets
and lengths beside it. Any record can then be read without the ones before it. Nothing but a
piece of a record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.tiles import join_one
from kinweave.workspace import Workspace

PIECE = 1 << 18
#: An archive is closed when it has this many bytes before compression.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many digests that several pages share, some 60 bytes each, are broadcast.
MAX_BROADCAST = 100_000


def _urn(page_id) -> str:
    """A page's name: nothing for a null id, one percent sign for an empty one."""
    inner = "" if page_id is None else quote(str(page_id), safe="") or "%"
    return f"<urn:x-page:{inner}>"


def _file(path: str, mode: str):
    where, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        return where.open_output_stream(name, compression=None)
    return where.open_input_file(name) if mode == "r" else where.open_input_stream(name, compression=None)


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> tuple[bytes, bytes]:
    """Headers and body of a response, or of a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass"), body


class _Inflated:
    """Reads a gzip file of one member or more, a piece at a time."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.left = source, b""
        self.inflate = zlib.decompressobj(31)
        self.raw = b""

    def more(self) -> bool:
        """Add to ``left``; false at the end."""
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            raw = self.raw or self.source.read(PIECE)
            self.raw = b""
            if not raw:
                return False
            out = self.inflate.decompress(raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if out:
                self.left += out
                return True

    def head(self) -> bytes | None:
        """Headers of the next record with their blank line, or None at the end."""
        while (at := self.left.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.left.strip():
                    raise ValueError("the archive ends within a record's headers")
                return None
        out, self.left = self.left[: at + 4], self.left[at + 4 :]
        return out

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.left and not self.more():
                raise ValueError("the archive ends within a record")
            piece, self.left = self.left[:size], self.left[size:]
            size -= len(piece)
            yield piece

    def skip(self, what: bytes) -> None:
        while len(self.left) < len(what):
            if not self.more():
                raise ValueError("the archive ends before the end of a record")
        if not self.left.startswith(what):
            raise ValueError("a record is longer than it says")
        self.left = self.left[len(what) :]


def fields(head: bytes) -> dict[str, str]:
    """The headers of a record, names in lower case."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO) -> int:
    """Rewrite a whole-file gzip archive with a member and an index line for each record."""
    archive, offset, n = _Inflated(source), 0, 0
    while (head := archive.head()) is not None:
        names, squeeze, length = fields(head), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal length
            target.write(data)
            length += len(data)

        put(squeeze.compress(head))
        for piece in archive.body(int(names["content-length"])):
            put(squeeze.compress(piece))
        archive.skip(b"\r\n\r\n")
        put(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        entry = {"id": names["warc-record-id"], "type": names["warc-type"], "offset": offset, "length": length}
        index.write(json.dumps(entry).encode() + b"\n")
        offset += length
        n += 1
    return n


def _member(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(data, 31)
    at = raw.index(b"\r\n\r\n") + 4
    names = fields(raw[:at])
    return names, raw[at : at + int(names["content-length"])]


def _id(urn: str) -> str | None:
    inner = urn[len("<urn:x-page:") : -1]
    return None if not inner else "" if inner == "%" else unquote(inner)


def _page(names: dict[str, str], body: bytes) -> tuple:
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    digest = base64.b32decode(names["warc-payload-digest"].removeprefix("sha1:")).hex()
    if names["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{names['warc-record-id']}: payload and digest differ")
    refers = names.get("warc-refers-to")
    return _id(names["warc-record-id"]), size, digest, names["warc-type"], _id(refers) if refers else None


def _writer(folder: str):
    def run(batches):
        made, out, squeeze, size = [], None, None, 0

        def close():
            nonlocal out
            if out is not None:
                out.write(squeeze.flush())
                out.close()
                out = None

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    made.append(f"{folder}/{uuid.uuid4().hex}")
                    out, squeeze, size = _file(f"{made[-1]}.warc.gz", "w"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                for part in (*record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to), b"\r\n\r\n"):
                    out.write(squeeze.compress(part))
                    size += len(part)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["archive"])

    return run


def _normaliser(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with (
                _file(f"{name}.warc.gz", "s") as source,
                _file(f"{name}.records.warc.gz", "w") as target,
                _file(f"{name}.index.jsonl", "w") as index,
            ):
                n = normalise(source, target, index)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])


_PAGE = pa.schema([
    ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()),
])


def _reader(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with _file(f"{name}.index.jsonl", "s") as index:
                entries = [json.loads(x) for x in index.read().splitlines()]
            with _file(f"{name}.records.warc.gz", "r") as records:
                found = []
                for e in entries:
                    records.seek(e["offset"])
                    found.append(_page(*_member(records.read(e["length"]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PAGE)] if found else [pa.array([], f.type) for f in _PAGE], schema=_PAGE)


def write_archives(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Write a record for each page and return ``(archive)``, the archives' base paths.

    Among equal payloads of at least ``least`` bytes the page with the largest id is the
    response and the others are revisits of it. A page without an id is a revisit where such a
    page has one; rows that share the largest id are all responses. A null payload is empty.
    Payloads stay where they are if few digests are shared, else only large ones are exchanged.
    """
    folder = work.folder("archives")
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(payload).alias("digest"),
    )
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= least
    digests = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    best = work.table(digests.where("n > 1").select("digest", "best"), "best")
    if best.count() <= MAX_BROADCAST:
        met = rows.join(F.broadcast(best), "digest", "left")
    else:  # small payloads, and the empty ones that are all alike, stay out of the exchange
        small = rows.where(~large).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
        met = join_one(rows.where(large), digests.select("digest", F.when(F.col("n") > 1, F.col("best")).alias("best")), "digest").unionByName(small)
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    to_write = met.select(F.col("page_id").cast("string"), "url", "html", "digest", refers_to.cast("string").alias("refers_to"))
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return work.table(to_write.mapInArrow(_writer(folder), "archive string"), "written")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write pages to archives, normalise these, and read every record by its index entry.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row for
    each page, whose id may be a number or a text; an empty table gives none. Each file has a name of its own, and a path is only
    passed on by the task that ended well, so a task that runs again leaves a stray file and
    no record twice.
    """
    work = Workspace(pages.sparkSession, "warc")
    written = write_archives(pages, work, **names)
    spread = written.repartition(max(1, written.count()), "archive")
    normalised = work.table(spread.mapInArrow(_normaliser, "archive string, records long"), "normalised")
    spread = normalised.select("archive").repartition(max(1, normalised.count()), "archive")
    read = spread.mapInArrow(
        _reader, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )
    kind = pages.schema[names.get("id_col", "page_id")].dataType
    return read.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
