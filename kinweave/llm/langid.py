"""Language ID by a byte convolutional network, trained and applied in numpy.

A window is WINDOW bytes. Filters of several widths slide over embedded bytes; the largest
response of each filter in the window, above zero, goes to a softmax over languages. A text
is cut into windows from its first byte to its last, and the mean of their log-probabilities
decides. To apply the network, embedding and filters are folded into tables of responses by
pairs of bytes, so that a position costs two look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinweave.llm.bytetok import to_bytes
from kinweave.llm.sampling import Adam, fold

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
PLACES = WINDOW - max(WIDTHS) + 1
#: Texts that teach, at most about, the same number of each language; all their windows do.
MAX_TAUGHT = 4000
EPOCHS = 3
BATCH = 128
#: Windows held at a time when the network is applied.
HELD = 1024


def has_letter(text: str) -> bool:
    """Whether a character's category is letter; numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text; the last is filled with spaces."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def train(x: np.ndarray, y: np.ndarray, n_classes: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Cross-entropy training on windows ``x`` (n, WINDOW) with classes ``y``."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
    for w in WIDTHS:
        p[f"filter{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
        p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
    total = FILTERS * len(WIDTHS)
    p["out"] = rng.normal(0, total**-0.5, (total, n_classes)).astype(np.float32)
    p["out_bias"] = np.zeros(n_classes, np.float32)
    adam = Adam(p, 0.004)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            adam.step(_gradients(p, x[part], y[part]))
    return p


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = len(x)
    emb = p["embed"][x]
    pooled, chosen = [], []
    for w in WIDTHS:
        col = np.concatenate([emb[:, j : j + PLACES] for j in range(w)], axis=2)
        out = col @ p[f"filter{w}"]
        best = out.argmax(axis=1)
        pooled.append(np.take_along_axis(out, best[:, None], 1)[:, 0] + p[f"bias{w}"])
        chosen.append(best)
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    logits = hidden @ p["out"] + p["out_bias"]
    prob = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    prob[np.arange(n), y] -= 1
    prob /= n
    g = {"out": hidden.T @ prob, "out_bias": prob.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    back = (prob @ p["out"].T) * (hidden > 0)
    for i, w in enumerate(WIDTHS):
        grad = back[:, i * FILTERS : (i + 1) * FILTERS]
        place = chosen[i][:, :, None] + np.arange(w)
        seen = x[np.arange(n)[:, None, None], place]
        g[f"bias{w}"] = grad.sum(axis=0)
        g[f"filter{w}"] = np.einsum("nf,nfwe->wef", grad, p["embed"][seen]).reshape(w * EMBED, FILTERS)
        to_embed = grad[:, :, None, None] * p[f"filter{w}"].reshape(w, EMBED, FILTERS).transpose(2, 0, 1)
        np.add.at(g["embed"], seen, to_embed)
    return g


class Network:
    """The trained network in the form in which it is applied."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        def response(w: int, j: int) -> np.ndarray:
            return p["embed"] @ p[f"filter{w}"][j * EMBED : (j + 1) * EMBED] if j < w else np.zeros((256, FILTERS), np.float32)

        def pairs(j: int) -> np.ndarray:
            first, second = (np.concatenate([response(w, k) for w in WIDTHS], axis=1) for k in (j, j + 1))
            return (first[:, None] + second[None]).reshape(65536, -1)

        self.head, self.tail = pairs(0), pairs(2)
        self.bias = np.concatenate([p[f"bias{w}"] for w in WIDTHS])
        self.out, self.out_bias = p["out"], p["out_bias"]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.out_bias)), np.float32)
        for at in range(0, len(x), HELD):
            part = x[at : at + HELD].astype(np.uint16)
            pair = part[:, :-1] * np.uint16(256) + part[:, 1:]
            seen = self.head[pair[:, :PLACES]]
            seen += self.tail[pair[:, 2 : 2 + PLACES]]
            hidden = np.maximum(seen.max(axis=1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + HELD] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def _teaching(batches):
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        found = [(lang, w.tobytes()) for lang, t in zip(langs, texts) if has_letter(t) for w in windows(to_bytes(t))]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.binary())], ["lang", "window"])


def _predicting(held):
    def run(batches):
        params, classes = held.value
        network = Network(params) if classes else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            rows, parts, size = [], [], 0

            def flush():
                nonlocal rows, parts, size
                if rows:
                    logs = network.log_probabilities(np.concatenate(parts))
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1]))
                    sums = np.add.reduceat(logs.astype(np.float64), cuts) / np.array([len(x) for x in parts])[:, None]
                    prob = np.exp(sums - sums.max(axis=1, keepdims=True))
                    prob /= prob.sum(axis=1, keepdims=True)
                    for row, k, q in zip(rows, prob.argmax(axis=1), prob.max(axis=1)):
                        pred[row], score[row] = classes[k], float(q)
                rows, parts, size = [], [], 0

            for row, text in enumerate(texts):
                if network and text is not None and has_letter(text):
                    rows.append(row)
                    parts.append(windows(to_bytes(text)))
                    size += len(parts[-1])
                if size >= HELD:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred), pa.array(score, pa.float64())],
                ["id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2
) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for each row.

    Rows of the held fold, by the crc32 of the id, teach nothing; a null id is in fold 0. Of the
    others with a text and a language a bounded sample does, taken of each language by hash, so
    that every language is learned. ``und`` with score 0 is given to null texts and
    to texts without a letter, and to all if nothing could be learned. Windows are bytes of
    the whole text, and a character may be cut between two. Repeated rows repeat their result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    taught = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = taught.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(float(MAX_TAUGHT)) / F.count("*").over(Window.partitionBy()), F.lit(1.0))
    shares = sizes.select(F.col("lang").alias("known"), F.least(each / F.col("n"), F.lit(1.0)).alias("share"))
    draw = F.pmod(F.xxhash64("id", "lang", "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    taught = taught.join(F.broadcast(shares), F.col("lang") == F.col("known")).where(draw < F.col("share")).select("lang", "text")
    found = sorted((r.lang, bytes(r.window)) for r in taught.mapInArrow(_teaching, "lang string, window binary").collect())
    classes = sorted({lang for lang, _ in found})
    params: dict[str, np.ndarray] = {}
    if classes:
        x = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
        params = train(x, np.array([classes.index(lang) for lang, _ in found]), len(classes))
    held = docs.sparkSession.sparkContext.broadcast((params, classes))
    out = rows.select("id", "held_out", "text").mapInArrow(
        _predicting(held), f"id {id_type}, held_out boolean, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
