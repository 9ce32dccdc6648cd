"""Groups of similar texts: SimHash fingerprints find pairs, shingle sets settle them.

The fingerprint is a SimHash of WORDS * 64 bits over a text's different shingles. Texts that
share 0.8 of their shingles have an angle with a cosine of 0.89 at least, so each bit differs
with a probability of 0.15 at most: 39 of 256 bits on average, where those of unrelated texts
differ in 128. Blocks that such texts surely share would have a bit or two each, so keys are
TABLES choices of MOST_BITS bits, of which few texts use the first ones only. Texts that agree
in a key and differ in at most FAR bits meet. A pair is missed with a probability of
:func:`missed`: at a similarity of 0.8 it is 1e-6 for up to a quarter of a million texts and
9e-5 for over half a million, and less above.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.tiles import blocks, dealt, join_one, spanning
from kinweave.operators.components import connected_components
from kinweave.workspace import Workspace

SEED = 42
#: Words of the fingerprint, and bits in which a pair may differ, in all and in one word.
WORDS, FAR, FAR_IN_WORD = 4, 74, 24
BITS = 64 * WORDS
#: Keys of a fingerprint; their bits are so many that a key has MANY fingerprints, within bounds.
TABLES, LEAST_BITS, MOST_BITS, MANY = 64, 8, 10, 1024
#: Fingerprints of a table that go to one task on average, and that leave a task at a time.
SHARE_MARKS, HELD_MARKS = 1 << 16, 1 << 18
#: Fingerprints of a key that are compared outright, and pairs looked at in one step.
OUTRIGHT, STEP = 2048, 1 << 15
#: Tiles go out in as many shares as keep each to about so many bytes of text.
SHARE_BYTES = 4 << 20
_SLICE = 1 << 12
_RNG = np.random.default_rng(SEED)
_TURN = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_TURN[0] = 0
_MIX = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_A_ROUND = BITS // MOST_BITS
_CHOSEN = np.concatenate(
    [_RNG.permutation(BITS)[: _A_ROUND * MOST_BITS].reshape(_A_ROUND, MOST_BITS) for _ in range(-(-TABLES // _A_ROUND))]
)[:TABLES]


def key_bits(n: int) -> int:
    """How many bits the keys of ``n`` fingerprints have."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / MANY))))


def missed(similarity: float, bits: int = MOST_BITS) -> float:
    """The chance that two large texts of this similarity do not meet by keys of so many bits."""
    flip = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = 0.0
    for d in range(BITS + 1):
        log = math.lgamma(BITS + 1) - math.lgamma(d + 1) - math.lgamma(BITS - d + 1)
        of_d = math.exp(log + d * math.log(flip) + (BITS - d) * math.log1p(-flip)) if flip else float(d == 0)
        agree = math.comb(BITS - d, bits) / math.comb(BITS, bits)
        chance += of_d * (1.0 if d > FAR else (1 - agree) ** TABLES)
    return chance


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, in order; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def sketch(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles as WORDS numbers; its first 64 bits are those of the XXH64 hashes.

    A bit is 1 if set in over half the hashes. Further bits are of the hashes mixed again.
    """
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), _SLICE):
        h = found[at : at + _SLICE, None] ^ _TURN
        again = h[:, 1:]
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            again = (again ^ (again >> np.uint64(shift))) * np.uint64(times)
        h[:, 1:] = again ^ (again >> np.uint64(31))
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(found)).view(np.uint64)


def nodes(marks: np.ndarray) -> np.ndarray:
    """One number for each fingerprint."""
    return ((marks ^ (marks >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def keys(marks: np.ndarray, t: int, bits: int) -> np.ndarray:
    """The key of each fingerprint in table ``t``."""
    out = np.zeros(len(marks), np.int32)
    for bit in _CHOSEN[t, :bits].tolist():
        out = out << 1 | (marks[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int32)
    return out


def _marks(columns) -> np.ndarray:
    return np.stack([np.asarray(c, np.int64) for c in columns], axis=1).view(np.uint64)


_MARKS = [f"s{i}" for i in range(WORDS)]


def _prints(width: int):
    def run(batches):
        for batch in batches:
            prints, empty = [], []
            marks = np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = _words(text)
                prints.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                empty.append(not words)
                if words:
                    marks[i] = sketch(shingles(words, width))
            mask = np.array(empty, bool)
            cols = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(nodes(marks), mask=mask)]
            cols += [pa.array(marks[:, k].copy().view(np.int64), mask=mask) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "text", "fp", "node", *_MARKS])

    return run


def _listing(bits: int):
    """Fingerprints packed by table and by the first ``bits`` bits of their key."""

    def packed(marks: np.ndarray):
        for t in range(TABLES):
            share = keys(marks, t, bits)
            order = np.argsort(share, kind="stable")
            cuts = np.searchsorted(share[order], np.arange((1 << bits) + 1))
            found = np.flatnonzero(np.diff(cuts))
            blobs = [marks[order[cuts[s] : cuts[s + 1]]].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(blobs, pa.binary())],
                ["t", "share", "marks"],
            )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(_marks(batch.columns))
            size += batch.num_rows
            if size >= HELD_MARKS:
                yield from packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from packed(np.concatenate(held))

    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _close(rows: np.ndarray, among: np.ndarray | None = None):
    """(i, j) of close fingerprints of ``rows`` and ``among``, or of later rows, step by step."""
    first = np.ascontiguousarray((rows if among is None else among)[:, 0])
    high = max(1, STEP // max(1, len(first)))
    for at in range(0, len(rows), high):
        skip = at if among is None else 0
        hit = np.bitwise_count(rows[at : at + high, 0, None] ^ first[None, skip:]) <= FAR_IN_WORD
        i, j = np.divmod(np.flatnonzero(hit), len(first) - skip)
        i, j = i + at, j + skip
        near = _differing(rows[i], (rows if among is None else among)[j]) <= FAR
        if among is None:
            near &= i < j
        yield i[near], j[near]


def close_links(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all close pairs of ``marks`` would.

    Of many fingerprints those around a leader are linked to it, and only the others are held
    against them, so that a large cluster is not compared with itself.
    """
    out, todo = [], np.arange(len(marks))
    while len(todo) > OUTRIGHT:
        leaders = todo[:: len(todo) // 8]
        around = [_differing(marks[todo], marks[i]) <= FAR for i in leaders]
        best = int(np.argmax([a.sum() for a in around]))
        if around[best].sum() < len(todo) // 16:
            break
        own, rest = todo[around[best]], todo[~around[best]]
        out += [(int(leaders[best]), int(j)) for j in own if j != leaders[best]]
        for i, j in _close(marks[rest], marks[own]):
            first, at = np.unique(i, return_index=True)
            out += zip(rest[first].tolist(), own[j[at]].tolist())
        todo = rest
    labels = np.arange(len(todo))
    for i, j in _close(marks[todo]):
        differ = labels[i] != labels[j]
        for a, b in zip(i[differ].tolist(), j[differ].tolist()):
            if labels[a] != labels[b]:
                out.append((int(todo[a]), int(todo[b])))
                labels[labels == labels[b]] = labels[a]
    return out


def _near(bits: int):
    """Links between close fingerprints that agree in a key of so many bits."""

    def run(group: pa.Table) -> pa.Table:
        marks = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint64).reshape(-1, WORDS)
        key = keys(marks, group["t"][0].as_py(), bits)
        order = np.argsort(key, kind="stable")
        marks, key = marks[order], key[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        found = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if b - a > 1:
                found += [(a + i, a + j) for i, j in close_links(marks[a:b])]
        u, v = zip(*found) if found else ((), ())
        node = nodes(marks)
        return pa.table({"u": pa.array(node[list(u)], pa.int64()), "v": pa.array(node[list(v)], pa.int64())})

    return run


def _links(marks: DataFrame) -> DataFrame:
    """Links that connect the close fingerprints that share a key."""
    n = marks.count()
    bits, parallel = key_bits(n), marks.sparkSession.sparkContext.defaultParallelism
    first = min(bits, max(0, math.ceil(math.log2(max(1, n) / SHARE_MARKS))))
    listed = marks.select(*_MARKS).mapInArrow(_listing(first), "t int, share int, marks binary")
    listed = listed.repartition(max(parallel, TABLES * (1 << first) // 4), "t", "share")
    return listed.groupBy("t", "share").applyInArrow(_near(bits), "u long, v long").distinct()


def similar_pairs(
    sets: list[np.ndarray], marks: np.ndarray, asked: np.ndarray, among: np.ndarray, least: float
) -> list[tuple[int, int]]:
    """Links between sets ``asked`` and ``among`` that connect what all links of close fingerprints would."""
    sizes = np.array([len(s) for s in sets])
    among = among[np.argsort(sizes[among], kind="stable")]
    ordered = sizes[among]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(len(values), np.int32)

    def partners(i: int, labels: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(ordered, sizes[i] * least - 1e-9, side="left")
        hi = np.searchsorted(ordered, sizes[i] / least + 1e-9, side="right")
        some = among[lo:hi]
        some = some[labels[some] != labels[i]]
        some = some[_differing(marks[some], marks[i]) <= FAR]
        if not len(some) or not sizes[i]:
            return among[:0]
        own = code[cuts[i] : cuts[i + 1]]
        flag[own] = 1
        n = sizes[some]
        start = np.cumsum(n) - n
        both = np.add.reduceat(flag[code[np.repeat(cuts[some] - start, n) + np.arange(n.sum())]], start)
        flag[own] = 0
        return some[both / (sizes[i] + n - both) >= least]

    return spanning(asked, len(sets), partners)


def _settle(width: int, least: float):
    def run(tile: pa.Table) -> pa.Table:
        lo, hi = tile["lo"][0].as_py(), tile["hi"][0].as_py()
        block, fp = tile["block"].to_numpy(), tile["fp"].to_numpy()
        found = []
        if (block == lo).any() and (block == hi).any() and len(fp) > 1:
            sets = [shingles(_words(t), width) for t in tile["text"].to_pylist()]
            marks = _marks(tile[c].to_numpy() for c in _MARKS)
            found = similar_pairs(sets, marks, np.flatnonzero(block == lo), np.flatnonzero(block == hi), least)
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(fp[list(u)], pa.int64()), "v": pa.array(fp[list(v)], pa.int64())})

    return run


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8
) -> DataFrame:
    """Groups of texts linked by shingle similarity: ``(id, component_id)``.

    Words are maximal runs without ASCII white space after lower-casing A-Z; a text's set
    holds its shingles of ``width`` words, or all its words if they are fewer. Texts are
    linked if the sets' intersection is at least ``least`` of their union, and the least id
    that can be reached names the group. Texts without words are one group.

    Links between close SimHash fingerprints connect texts to parts; within a part, texts with
    close fingerprints are compared by their sets, as 64-bit hashes. They meet in tiles of
    bounded size, where each text comes once, and a tile returns only as many links as connect
    its groups: no pair is a row. Copies count as one text.

    Every input row gives one output row. A null id gives a row; a group with null ids alone
    has a null ``component_id``. Other input columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "similar")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = ", ".join(f"{c} long" for c in ("fp", "node", *_MARKS))
    rows = work.table(rows.mapInArrow(_prints(width), f"id {id_type}, text string, {columns}"), "prints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"), *[F.any_value(c).alias(c) for c in ("node", *_MARKS)])
    distinct = work.table(distinct, "distinct")
    known = distinct.where("node IS NOT NULL")
    marks = work.table(known.groupBy("node").agg(*[F.any_value(c).alias(c) for c in _MARKS]), "marks")
    parts = connected_components(work.table(_links(marks), "close"), Workspace(spark, "similar-parts"))
    placed = known.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("part"))
    placed = work.table(placed, "placed")
    several = placed.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    met = work.table(join_one(placed, several.select("part"), "part"), "met")

    texts = rows.select("fp", "text", *_MARKS).join(met.select("fp"), "fp", "left_semi")
    texts = work.table(texts.groupBy("fp").agg(*[F.any_value(c).alias(c) for c in ("text", *_MARKS)]), "texts")
    sizes = texts.select("fp", F.octet_length("text").cast("long").alias("size"))
    whole = met.join(sizes, "fp").groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = whole.select("part", blocks(F.col("n"), F.col("size")).alias("blocks"))
    tiles = work.table(dealt(join_one(met, whole, "part"), "fp"), "tiles")
    total = tiles.join(sizes, "fp").agg(F.sum("size")).first()[0] or 0
    shares = max(spark.sparkContext.defaultParallelism, int(total // SHARE_BYTES) + 1)
    tile = ["part", "lo", "hi"]
    links = tiles.join(texts, "fp").repartition(shares, *tile).groupBy(*tile).applyInArrow(_settle(width, least), "u long, v long")
    ends = connected_components(work.table(links.distinct(), "links"), work).withColumnRenamed("node", "fp")

    named = distinct.select("fp", "least").join(ends, "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    named = work.table(named.select("fp", "least", "part"), "named")
    first = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = work.table(named.join(first, "part").select("fp", "component_id"), "components")
    return join_one(rows.select("id", "fp"), named, "fp").select(F.col("id").alias(id_col), "component_id")
