"""Quality scores by attention-based multiple-instance learning, trained in numpy.

A text is a bag of passages of PASSAGE words. Each passage is encoded from the mean of its
hashed words' embeddings and from statistics of its bytes. Gated attention weighs the
encodings, and the weighted sum is scored. Only the label of the whole text is learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.bytetok import Chunk, chunks, to_bytes, word_hashes
from kinweave.llm.sampling import Adam, bounded, fold

PASSAGE = 64
BUCKETS = 1 << 14
EMBED = 8
HIDDEN = 16
GATE = 8
#: Labelled texts that teach, at most about; all their passages do.
MAX_TAUGHT = 6000
EPOCHS = 4
BATCH = 64

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_LOWER[0x80:] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[list(b"#*$%&|<>@^~_=+{}[]\\/`")] = True
_STOP[list(b".,;:!?'\"()-")] = True
_CLASSES = (_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP)
N_STATS = len(_CLASSES) + 4


class Passages:
    """Encoder inputs of the passages of a chunk; a text without words has one empty passage."""

    def __init__(self, chunk: Chunk) -> None:
        n_words = np.diff(chunk.bounds)
        per_text = np.maximum(1, -(-n_words // PASSAGE))
        self.bounds = np.concatenate(([0], np.cumsum(per_text)))
        text = np.repeat(np.arange(chunk.n_texts), per_text)
        nth = np.arange(self.bounds[-1]) - self.bounds[text]
        first = chunk.bounds[text] + nth * PASSAGE
        last = np.minimum(first + PASSAGE, chunk.bounds[text + 1])
        self.sizes = last - first
        hashes = word_hashes(chunk.data, chunk.starts, chunk.ends)
        self.buckets = (hashes >> np.uint64(64 - 14)).astype(np.int32)
        self.first = first
        size = np.maximum(self.sizes, 1).astype(np.float32)
        full = self.sizes > 0
        lo = np.where(full, np.append(chunk.starts, 0)[np.minimum(first, len(chunk.starts))], 0)
        hi = np.where(full, np.append(chunk.ends, 0)[np.maximum(last - 1, 0)], 0)
        stats = np.zeros((len(first), N_STATS), np.float32)
        length = np.maximum(hi - lo, 1)
        for k, kind in enumerate(_CLASSES):
            upto = np.concatenate(([0], np.cumsum(kind[chunk.data], dtype=np.int64)))
            stats[:, k] = (upto[hi] - upto[lo]) / length
        passage = np.repeat(np.arange(len(first)), self.sizes)
        order = np.lexsort((hashes, passage))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        distinct = np.bincount(passage[order][new], minlength=len(first))
        after = len(_CLASSES)
        stats[:, after] = distinct / size
        stats[:, after + 1] = (hi - lo) / size / 10
        stats[:, after + 2] = self.sizes / PASSAGE
        stats[:, after + 3] = ~full
        self.stats = stats


def _segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows bounds[i]:bounds[i + 1]; empty stretches sum to zero."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def encode(p: dict, buckets: np.ndarray, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and encodings of passages; ``words`` bounds the words of each."""
    size = np.maximum(np.diff(words), 1)[:, None]
    mean = _segment_sum(p["embed"][buckets], words) / size
    x = np.concatenate((mean, stats), axis=1).astype(np.float32)
    return x, np.tanh(x @ p["encode"] + p["encode_bias"])


def attend(p: dict, h: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gate parts, attention weights and the weighted encoding of each bag."""
    a, b = np.tanh(h @ p["gate_a"]), _sigmoid(h @ p["gate_b"])
    e = np.exp(np.clip((a * b) @ p["gate"], -30, 30))
    bag = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    weight = e / _segment_sum(e, bags)[bag]
    return a, b, weight, _segment_sum(weight[:, None] * h, bags), bag


def score(p: dict, passages: Passages) -> np.ndarray:
    words = np.append(passages.first, passages.first[-1] + passages.sizes[-1])
    _, h = encode(p, passages.buckets, words, passages.stats)
    z = attend(p, h, passages.bounds)[3]
    return _sigmoid(z @ p["out"] + p["out_bias"])


def train(bags: list[tuple], labels: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Learn from bags of (buckets, words per passage, statistics) and their labels."""
    rng = np.random.default_rng(seed)
    wide = EMBED + N_STATS
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    p = {
        "embed": rng.normal(0, 0.1, (BUCKETS, EMBED)).astype(np.float32),
        "encode": draw(wide, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32),
        "gate_a": draw(HIDDEN, GATE), "gate_b": draw(HIDDEN, GATE), "gate": draw(GATE),
        "out": draw(HIDDEN), "out_bias": np.zeros(1, np.float32),
    }
    adam = Adam(p, 0.005)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            adam.step(_gradients(p, [bags[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]]))
    return p


def _gradients(p: dict, part: list[tuple], y: np.ndarray) -> dict[str, np.ndarray]:
    buckets = np.concatenate([b for b, _, _ in part])
    sizes = np.concatenate([s for _, s, _ in part])
    stats = np.concatenate([s for _, _, s in part])
    words = np.concatenate(([0], np.cumsum(sizes)))
    bags = np.concatenate(([0], np.cumsum([len(s) for _, s, _ in part])))
    x, h = encode(p, buckets, words, stats)
    a, b, weight, z, bag = attend(p, h, bags)
    d = (_sigmoid(z @ p["out"] + p["out_bias"]) - y).astype(np.float32) / len(part)
    g = {"out": z.T @ d, "out_bias": np.array([d.sum()], np.float32)}
    dz = d[:, None] * p["out"]
    to_weight = (dz[bag] * h).sum(axis=1)
    spread = weight * (to_weight - _segment_sum(weight * to_weight, bags)[bag])
    g["gate"] = (a * b).T @ spread
    da = spread[:, None] * p["gate"] * b * (1 - a * a)
    db = spread[:, None] * p["gate"] * a * b * (1 - b)
    g["gate_a"], g["gate_b"] = h.T @ da, h.T @ db
    dh = weight[:, None] * dz[bag] + da @ p["gate_a"].T + db @ p["gate_b"].T
    dx = dh * (1 - h * h)
    g["encode"], g["encode_bias"] = x.T @ dx, dx.sum(axis=0)
    each = (dx @ p["encode"].T)[:, :EMBED] / np.maximum(sizes, 1)[:, None]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], buckets, np.repeat(each, sizes, axis=0).astype(np.float32))
    return g


def _teaching(batches):
    """A row for each labelled text: its label and its passages, as bytes."""
    for batch in batches:
        labels, texts = batch.column(0).to_pylist(), [to_bytes(t) for t in batch.column(1).to_pylist()]
        found = []
        for chunk in chunks(texts):
            passages = Passages(chunk)
            for i in range(chunk.n_texts):
                lo, hi = passages.bounds[i : i + 2]
                at = np.arange(lo, hi)
                buckets = [passages.buckets[f : f + n] for f, n in zip(passages.first[at], passages.sizes[at])]
                found.append((
                    labels[chunk.first + i], np.concatenate(buckets).tobytes(),
                    passages.sizes[at].astype(np.int32).tobytes(), passages.stats[at].tobytes(),
                ))
        if found:
            cols = zip(*found)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["label", "buckets", "sizes", "stats"])


def _scoring(held, threshold: float):
    def run(batches):
        params = held.value
        for batch in batches:
            texts = [to_bytes(t) for t in batch.column(2).to_pylist()]
            parts = [score(params, Passages(c)) for c in chunks(texts)] if params else [np.full(len(texts), 0.5)]
            value = np.concatenate(parts or [np.empty(0)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, folds: int = 5, held_fold: int = 0,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row; higher means label 1 is likelier.

    Rows of the held fold, by the crc32 of the id, teach nothing; of the other labelled rows a
    bounded sample does. The whole text is scored. A null text is an empty one: a single
    passage without words, which has a score like any other. Null labels and ids teach nothing.
    Repeated rows repeat their score. Without a label to learn from every score is 0.5.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).alias("text")
    )
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    taught = taught.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold("id", folds) != held_fold))
    taught = F.broadcast(bounded(taught.distinct(), MAX_TAUGHT))  # an id and a label each
    taught = rows.select("id", "text").join(taught, "id").select("label", "text")
    found = taught.mapInArrow(_teaching, "label int, buckets binary, sizes binary, stats binary").collect()
    found = sorted((r.label, bytes(r.buckets), bytes(r.sizes), bytes(r.stats)) for r in found)
    bags = [
        (np.frombuffer(b, np.int32), np.frombuffer(s, np.int32), np.frombuffer(x, np.float32).reshape(-1, N_STATS))
        for _, b, s, x in found
    ]
    params = train(bags, np.array([label for label, *_ in found], np.float32)) if bags else {}
    held = docs.sparkSession.sparkContext.broadcast(params)
    out = rows.mapInArrow(_scoring(held, threshold), f"id {id_type}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
