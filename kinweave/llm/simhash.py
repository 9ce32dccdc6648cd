"""SimHash near-duplicate groups by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.llm.similar import similar_texts
from kinweave.llm.tiles import blocks as tile_blocks, dealt, join_one, spanning
from kinweave.operators.components import connected_components
from kinweave.workspace import Workspace

SEED = 42
_SLICE = 1 << 16
#: Up to so many fingerprints of a key are compared in a join, more in tiles.
JOINED = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        raw = b"".join([digest(buf[a:b], SEED) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            values = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["id", "fp"])

    return run


def _block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _close(distance: int):
    def run(tile: pa.Table) -> pa.Table:
        lo, hi = tile["lo"][0].as_py(), tile["hi"][0].as_py()
        block, fp = tile["block"].to_numpy(), tile["fp"].to_numpy()
        among = np.flatnonzero(block == hi)

        def partners(i: int, labels: np.ndarray) -> np.ndarray:
            return among[np.bitwise_count((fp[among] ^ fp[i]).view(np.uint64)) <= distance]

        u, v = zip(*found) if (found := spanning(np.flatnonzero(block == lo), len(fp), partners)) else ((), ())
        return pa.table({"u": pa.array(fp[list(u)], pa.int64()), "v": pa.array(fp[list(v)], pa.int64())})

    return run


def _links(prints: DataFrame, distance: int, blocks: int, work: Workspace) -> DataFrame:
    """Links that connect all distinct fingerprints at most ``distance`` bits apart.

    ``distance`` flipped bits touch that many of the ``blocks`` at most, so two close
    fingerprints agree on some choice of the other ``blocks - distance``. Each fingerprint
    is listed once for each choice; with six blocks and three bits a key holds 32 bits.
    Every pair of a key is looked at. Where a key has few fingerprints their links are all
    returned; those of many meet in tiles, which return as many links as connect them.
    """
    masks = _block_masks(blocks)
    keys = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    listed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(k)).cast("long")) for k in keys])).alias("t", "key"),
    )
    sizes = listed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = work.table(listed.join(sizes, ["t", "key"]), "met")
    few = met.where(F.col("n") <= JOINED).select("t", "key", "fp")
    other = few.select(F.col("fp").alias("fp2"), "t", "key")
    pairs = (
        few.join(other, ["t", "key"])
        .where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
        .select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    )
    many = met.where(F.col("n") > JOINED).withColumn("blocks", tile_blocks(F.col("n"), F.col("n") * 8))
    tiles = dealt(many, "fp").groupBy("t", "key", "lo", "hi").applyInArrow(_close(distance), "u long, v long")
    return pairs.union(tiles).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    distance: int = 3,
    blocks: int = 6,
    similarity: float | None = None,
) -> DataFrame:
    """Near-duplicate groups of whole texts: ``(id, fingerprint, component_id)``.

    Words are maximal runs without ASCII white space after lower-casing A-Z; a shingle is
    ``width`` words joined by a space and counts as often as it occurs. Texts whose
    fingerprints differ in ``distance`` bits or fewer are linked, and the least id that
    can be reached names the group. Copies share a fingerprint, so pairs are looked for
    between distinct fingerprints alone and a group of copies costs one row.

    A null or empty text has fingerprint zero and links like any other. Every input row
    gives one output row, repeated rows too. A null id gives a row; a group with null ids
    alone has a null ``component_id``. Other input columns are ignored. An empty table
    gives no rows.

    With ``similarity``, texts are linked that share so much of their sets of shingles, and
    the result is ``(id, component_id)``: such texts differ in too many of 64 bits for six
    blocks, so :func:`kinweave.llm.similar.similar_texts` takes a longer SimHash and more keys,
    and compares the sets of texts whose fingerprints are close.
    """
    if similarity is not None:
        return similar_texts(docs, id_col, text_col, width, similarity)
    spark = docs.sparkSession
    work = Workspace(spark, "simhash")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = work.table(rows.mapInArrow(_fingerprints(width), f"id {id_type.simpleString()}, fp long"), "prints")
    groups = work.table(rows.groupBy("fp").agg(F.min("id").alias("least")), "groups")
    parts = connected_components(_links(groups.select("fp"), distance, blocks, work), work)
    named = groups.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = work.table(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = work.table(named.join(least, "component").select("fp", "component_id"), "components")
    return join_one(rows, named, "fp").select(
        F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
