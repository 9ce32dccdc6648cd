"""Substring dedup: words that lie in a window of words found twice.

Level-wise doubling. Level one looks at windows of ``window // 4 + 1`` words, and only at
those which are the least-hashed in some window of the full length: equal full windows
choose them alike, so each full window has one, about one position in thirteen. Those
found twice are extended to twice the length, to the right and to the left, and those
found twice again to the full length, where the verdict falls on every full window left.

Whether a hash occurs twice is settled by exchange. A task sends, for its share of the
texts, each hash once with a mark if it met it more than once itself. Shares meet in
buckets by hash, so a hash that a third of all texts hold comes once from each share and
buckets are even; how many there are follows the size of the texts, so each holds a bounded
number of hashes, and each is a partition of its own. What occurs twice goes back to the
shares that asked.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.bytetok import Chunk, Windows, chunks, mix, to_bytes, word_hashes
from kinweave.workspace import Workspace

#: A task sends what it holds when it has gathered this many hashes (32 MB).
HELD_HASHES = 1 << 22
#: Bytes of text for each bucket. A level sends a hash for 40 bytes at most: the first one for
#: about one word in thirteen, the later ones for a window's start where windows repeat.
BUCKET_BYTES, LEAST_BUCKETS = 128 << 20, 16


@functools.lru_cache(maxsize=2)
def _reply(folder: str, share: int) -> np.ndarray:
    """The hashes of a share that occur twice, in order."""
    where, path = fs.FileSystem.from_uri(f"{folder}/share={share}")
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    parts = [
        np.frombuffer(blob, np.uint64)
        for f in found if f.is_file and f.path.endswith(".parquet")
        for blob in pq.read_table(f.path, filesystem=where, columns=["hashes"], partitioning=None)["hashes"].to_pylist()
    ]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    bits = np.zeros(1 << 20, bool)
    bits[known >> np.uint64(44)] = True
    out = bits[values >> np.uint64(44)]
    hit = np.flatnonzero(out)
    asked = values[hit]
    out[hit] = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
    return out


class _Texts:
    """Full windows of the texts in a chunk, and the level-one window that each chooses."""

    def __init__(self, chunk: Chunk, window: int) -> None:
        self.window, self.short = window, window // 4 + 1
        self.double = min(2 * self.short, window)
        self.hashes = Windows(word_hashes(chunk.data, chunk.starts, chunk.ends))
        begin = np.repeat(chunk.bounds[:-1], np.diff(chunk.bounds))
        end = np.repeat(chunk.bounds[1:], np.diff(chunk.bounds))
        place = np.arange(len(begin))
        self.begin, self.end = begin, end
        self.full = place[place + window <= end]

    def chosen(self) -> np.ndarray:
        """For each full window, where its level-one window starts."""
        if not len(self.full):
            return self.full
        n = len(self.begin)
        low = np.uint64((1 << 24) - 1)
        least = np.full(n, ~np.uint64(0))
        short = np.arange(max(0, n - self.short + 1))
        least[: len(short)] = self.hashes.at(short, self.short) & ~low
        out = []
        for at in range(0, n, 1 << 23):  # the place is kept in the low bits
            part = least[at : at + (1 << 23) + self.window].copy()
            part |= np.arange(len(part), dtype=np.uint64)
            have, span = 1, self.window - self.short + 1
            while have < span:
                step = min(have, span - have)
                part[:-step] = np.minimum(part[:-step], part[step:])
                have += step
            inside = self.full[(self.full >= at) & (self.full < at + (1 << 23))]
            out.append((part[inside - at] & low).astype(np.int64) + at)
        return np.concatenate(out)

    def told(self, chosen: np.ndarray) -> np.ndarray:
        """What is sent for level-one windows: their hashes are small ones, scrambled they are even."""
        return mix(self.hashes.at(chosen, self.short))

    def first(self) -> np.ndarray:
        return self.told(np.unique(self.chosen()))

    def second(self, repeated: np.ndarray) -> np.ndarray:
        chosen = np.unique(self.chosen())
        chosen = chosen[_among(self.told(chosen), repeated)]
        more = self.double - self.short
        right = chosen[chosen + self.double <= self.end[chosen]]
        left = chosen[chosen - more >= self.begin[chosen]] - more
        return self.hashes.at(np.unique(np.concatenate((right, left))), self.double)

    def third(self, repeated: np.ndarray) -> np.ndarray:
        chosen = self.chosen()
        if not len(chosen):
            return np.empty(0, np.uint64)
        more, offset = self.double - self.short, chosen - self.full
        keep = np.ones(len(chosen), bool)
        for inside, start in ((offset + self.double <= self.window, chosen), (offset >= more, chosen - more)):
            to_ask = np.flatnonzero(inside)
            places, back = np.unique(start[to_ask], return_inverse=True)
            keep[to_ask] &= _among(self.hashes.at(places, self.double), repeated)[back]
        return self.hashes.at(self.full[keep], self.window)

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """Which words of the chunk a repeated full window covers."""
        hit = self.full[_among(self.hashes.at(self.full, self.window), repeated)]
        step = np.zeros(len(self.begin) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + self.window, -1)
        return np.cumsum(step)[:-1] > 0


_ASKS: list[Callable[[_Texts, np.ndarray], np.ndarray]] = [
    lambda texts, _: texts.first(),
    lambda texts, repeated: texts.second(repeated),
    lambda texts, repeated: texts.third(repeated),
]


def _sent(share: int, held: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    cuts = [(b << 64) // buckets for b in range(1, buckets)]
    edges = np.concatenate(([0], np.searchsorted(values, np.array(cuts, np.uint64)), [len(values)])).astype(int)
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        yield int(b), share, values[part].tobytes(), np.packbits(counts[part] > 1).tobytes()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch, one share after the other."""
    for share in pc.unique(batch.column("share")).to_pylist():
        yield share, batch.filter(pc.equal(batch.column("share"), share))


def _asking(level: int, window: int, buckets: int, replies: str | None):
    names = ["bucket", "share", "hashes", "twice"]

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        if cols := list(zip(*found)):
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for share, part in _runs(batch):
                repeated = _reply(replies, share) if replies else np.empty(0, np.uint64)
                for chunk in chunks([to_bytes(t) for t in part.column("text").to_pylist()]):
                    asked = _ASKS[level](_Texts(chunk, window), repeated)
                    if len(asked):
                        held.setdefault(share, []).append(asked)
                        size += len(asked)
                    if size >= HELD_HASHES:
                        for s, h in held.items():
                            yield from rows(_sent(s, h, buckets))
                        held, size = {}, 0
        for s, h in held.items():
            yield from rows(_sent(s, h, buckets))

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one bucket, which is a partition, what occurs twice of the hashes that each share sent."""
    sent, marks, shares = [], [], []
    for batch in batches:
        for h, m, share in zip(*(batch.column(c).to_pylist() for c in ("hashes", "twice", "share"))):
            sent.append(np.frombuffer(h, np.uint64))
            marks.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(sent[-1])).astype(bool))
            shares.append(share)
    if not sent:
        return
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    repeated = np.union1d(values[counts > 1], np.concatenate([h[m] for h, m in zip(sent, marks)]))
    for share, h in zip(shares, sent):
        back = h[_among(h, repeated)]
        if len(back):
            yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([back.tobytes()], pa.binary())], ["share", "hashes"])


def _removing(window: int, replies: str):
    def run(batches):
        for batch in batches:
            for share, part in _runs(batch):
                repeated = _reply(replies, share)
                texts = [to_bytes(t) for t in part.column("text").to_pylist()]
                n_words, n_removed, kept = [], [], []
                for chunk in chunks(texts):
                    gone = _Texts(chunk, window).removed(repeated)
                    for i in range(chunk.n_texts):
                        words = texts[chunk.first + i].split()
                        mask = gone[chunk.bounds[i] : chunk.bounds[i + 1]]
                        n_words.append(len(words))
                        n_removed.append(int(mask.sum()))
                        if n_removed[-1]:
                            words = [words[j] for j in np.flatnonzero(~mask)]
                        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                rest = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] not in ("share", "text")]
                names = [n for n in part.schema.names if n not in ("share", "text")]
                yield pa.RecordBatch.from_arrays([*rest, *cols], [*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35
) -> DataFrame:
    """Cut every word that a repeated window of ``window`` words covers.

    Returns ``(id, n_words, n_removed, kept)``, one row for each input row; ``kept`` is the
    words left, joined by one space. A window is repeated if its word sequence also starts
    elsewhere, in the same text or another; windows are judged on the input and each place
    of a repeated window loses its words. Words are maximal runs without ASCII white space,
    unchanged in case.

    A null or empty text has no words and an empty ``kept``. Repeated rows repeat their
    windows and lose them. Null ids are kept; other input columns are ignored. Windows are
    compared by a 64-bit hash of their words, the shorter windows inside first, so a full
    window is asked about only where those inside it repeat: among n such windows about
    n*n/2**65 pairs are equal by chance, under 0.001 for 10**8.
    """
    if window < 4:
        raise ValueError("window must be at least 4")
    spark = docs.sparkSession
    work = Workspace(spark, "substrings")
    id_type = docs.schema[id_col].dataType.simpleString()
    shares = work.table(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("share")),
        "texts",
    )
    top, size = shares.agg(F.coalesce(F.max("share"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    replies = None
    for level in range(len(_ASKS)):
        asked = shares.mapInArrow(
            _asking(level, window, buckets, replies), "bucket int, share int, hashes binary, twice binary"
        )
        settled = asked.repartitionById(buckets, "bucket").mapInArrow(_settle, "share int, hashes binary")
        work.table(settled.repartitionById(top + 1, "share"), f"level-{level}", partition_by="share")
        replies = work.folder(f"level-{level}")
    out = shares.mapInArrow(_removing(window, replies), f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
