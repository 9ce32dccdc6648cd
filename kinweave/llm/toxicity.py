"""Toxicity by a counterfactually regularised classifier, trained in numpy.

A sentence's logit is the sum of weights of its hashed words and of the beginnings of longer
words, and a bias; a text is toxic if a sentence is. Labels are of whole texts, so training takes a text for toxic with the
probability that at least one sentence is. Wherever a labelled sentence names a group, the
name is swapped for another group's and for a neutral word, and the squared change of the
logit is penalised: a group's name alone can then hardly move a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.bytetok import chunks, mix, powers, to_bytes, word_hashes
from kinweave.llm.sampling import Adam, bounded, fold

BITS = 18
#: Labelled texts that teach, at most about; all their sentences do.
MAX_TAUGHT = 4000
#: Lengths in bytes of beginnings; each counts for words that are longer.
STARTS = (4, 5, 6, 7, 8)
#: A feature has a weight if this many taught texts hold it and the share of toxic ones among
#: these is so many standard deviations from the share among all.
MIN_TEXTS, MIN_Z = 4, 4.0
STEPS = 80
L2 = 1e-4
#: Weight of the counterfactual penalty, and swaps for each naming.
SWAP, SWAPS = 0.5, 3

#: Names of groups, and after them neutral words that may stand for them.
IDENTITY = (
    "women men girls boys black white asian african latino jewish jews muslim muslims christian christians hindu "
    "hindus buddhist catholic immigrant immigrants refugees gay lesbian transgender disabled deaf blind elderly "
    "femmes hommes noirs blancs juifs musulmans frauen männer schwarze juden muslime mujeres hombres negros judíos musulmanes"
).split()
NEUTRAL = "people persons neighbours personnes leute personas".split()

_ENDS = b".!?\n"
_FOLD = bytes(
    0x0A if c in _ENDS else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


#: Stands for no feature.
_NONE = 1 << BITS


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of each word and of its beginnings, a row for each word."""
    out = np.full((len(starts), 1 + len(STARTS)), _NONE, np.int32)
    out[:, 0] = word_hashes(data, starts, ends) >> np.uint64(64 - BITS)
    table, sums = powers(max(STARTS)), np.zeros(len(starts), np.uint64)
    for j in range(max(STARTS)):
        sums += (data[np.minimum(starts + j, len(data) - 1)].astype(np.uint64) + np.uint64(1)) * table[j]
        if j + 1 in STARTS:
            longer = np.flatnonzero(ends - starts > j + 1)
            bucket = mix(sums[longer] + np.uint64((j + 1) * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - BITS)
            out[longer, 1 + STARTS.index(j + 1)] = bucket
    return out


def sentences(texts: list[bytes]):
    """For each chunk: features of words, first word of each sentence, sentences of each text.

    A text without words has no sentence.
    """
    for chunk in chunks([t.translate(_FOLD) for t in texts]):
        if not len(chunk.starts):
            yield np.empty((0, 1 + len(STARTS)), np.int32), np.empty(0, int), np.zeros(chunk.n_texts + 1, int)
            continue
        line = np.cumsum(chunk.data == 0x0A)[chunk.starts]
        text = chunk.text_of_word()
        first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1]))))
        yield _features(chunk.data, chunk.starts, chunk.ends), first, np.searchsorted(first, chunk.bounds)


def _fold_text(text: str | None) -> bytes:
    return to_bytes((text or "").lower())


def _term_features(words: list[str]) -> np.ndarray:
    data = np.frombuffer(b" ".join(_fold_text(w) for w in words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 0x20)
    return _features(data, np.concatenate(([0], ends[:-1] + 1)), ends)


def train(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 1) -> dict:
    """Weights from words of sentences (``sizes`` words each) of texts (``counts`` sentences each)."""
    rng = np.random.default_rng(seed)
    first_word = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
    held_by, toxic_by = (np.zeros(_NONE + 1, np.int64) for _ in range(2))
    for i, label in enumerate(labels):
        own = np.unique(words[first_word[i] : first_word[i + 1]])
        held_by[own] += 1
        toxic_by[own] += int(label)
    share = labels.mean()
    z = (toxic_by - held_by * share) / np.sqrt(np.maximum(held_by * share * (1 - share), 1e-9))
    terms = _term_features(IDENTITY + NEUTRAL)
    known = (held_by >= MIN_TEXTS) & (np.abs(z) >= MIN_Z)
    known[terms] = True
    known[_NONE] = False
    code = np.cumsum(known) - 1
    place, column = np.nonzero(known[words])
    word = code[words[place, column]]
    sentence = np.repeat(np.arange(len(sizes)), sizes)[place]
    text_of_sentence = np.repeat(np.arange(len(counts)), counts)
    # which term each naming in the texts is, and the features that make up a term's logit
    at = {int(x): i for i, x in enumerate(terms[: len(IDENTITY), 0])}
    naming = np.array([at[x] for x in words[np.isin(words[:, 0], list(at)), 0].tolist()], np.int64)
    options = np.concatenate((np.arange(len(IDENTITY)), np.repeat(np.arange(len(IDENTITY), len(terms)), len(IDENTITY) // len(NEUTRAL))))
    part_of, column = np.nonzero(terms != _NONE)
    part = code[terms[part_of, column]]
    p = {"weight": np.zeros(int(known.sum())), "bias": np.array([-2.0])}
    adam = Adam(p, 0.15)
    n = len(labels)
    first = np.concatenate(([0], np.cumsum(counts)))
    full = np.flatnonzero(counts)
    # both labels weigh the same in sum
    importance = np.where(labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / n
    for _ in range(STEPS):
        logit = np.bincount(sentence, p["weight"][word], len(sizes)) + p["bias"]
        toxic = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        none = np.zeros(n)
        none[full] = np.add.reduceat(-np.logaddexp(0, np.clip(logit, -30, 30)), first[full])
        some = np.clip(1 - np.exp(none), 1e-9, 1)
        back = np.where(labels > 0, -np.exp(none) / some, 1.0) * importance
        d = back[text_of_sentence] * toxic
        g = np.bincount(word, d[sentence], len(p["weight"])) + L2 * p["weight"]
        if len(naming):
            logits = np.bincount(part_of, p["weight"][part], len(terms))
            pull = np.zeros(len(terms))
            for _ in range(SWAPS):
                other = options[rng.integers(0, len(options), len(naming))]
                change = 2 * SWAP * (logits[naming] - logits[other]) / len(naming) / SWAPS
                pull += np.bincount(naming, change, len(terms)) - np.bincount(other, change, len(terms))
            g += np.bincount(part, pull[part_of], len(g))
        adam.step({"weight": g, "bias": np.array([d.sum()])})
    weight = np.zeros(_NONE + 1, np.float32)
    weight[known] = p["weight"]
    return {"weight": weight, "bias": float(p["bias"][0])}


def _teaching(batches):
    for batch in batches:
        labels, texts = batch.column(0).to_pylist(), [_fold_text(t) for t in batch.column(1).to_pylist()]
        at, found = 0, []
        for buckets, first, bounds in sentences(texts):
            last = np.append(first[1:], len(buckets))
            for i in range(len(bounds) - 1):
                parts = [buckets[first[k] : last[k]] for k in range(bounds[i], bounds[i + 1])]
                found.append((
                    labels[at], b"".join(x.tobytes() for x in parts),
                    np.array([len(x) for x in parts], np.int32).tobytes(),
                ))
                at += 1
        if found:
            types = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["label", "buckets", "sizes"])


def scores(params: dict, texts: list[bytes]) -> np.ndarray:
    """The probability of the most toxic sentence of each text; the bias alone for no sentence."""
    out = []
    for buckets, first, bounds in sentences(texts):
        best = np.full(len(bounds) - 1, params["bias"])
        if len(first):
            logit = np.add.reduceat(params["weight"][buckets].sum(axis=1, dtype=np.float64), first) + params["bias"]
            full = np.flatnonzero(np.diff(bounds))
            best[full] = np.maximum.reduceat(logit, bounds[full])
        out.append(best)
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out or [np.empty(0)]), -30, 30)))


def _scoring(held, threshold: float):
    def run(batches):
        params = held.value
        for batch in batches:
            texts = [_fold_text(t) for t in batch.column(2).to_pylist()]
            value = scores(params, texts) if params else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.5, folds: int = 5, held_fold: int = 0,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row; higher means label 1 is likelier.

    Rows of the held fold, by the crc32 of the id, teach nothing; of the other labelled rows a
    bounded sample does. Every sentence of the whole text is scored. A null or empty text has
    the score of a sentence without words. Null labels and ids teach nothing. Repeated rows
    repeat their score. Without a label to learn from every score is 0.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).alias("text")
    )
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    taught = taught.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold("id", folds) != held_fold))
    taught = F.broadcast(bounded(taught.distinct(), MAX_TAUGHT))  # an id and a label each
    taught = rows.select("id", "text").join(taught, "id").select("label", "text")
    found = taught.mapInArrow(_teaching, "label int, buckets binary, sizes binary").collect()
    found = sorted((r.label, bytes(r.buckets), bytes(r.sizes)) for r in found)
    params = {}
    if found:
        sizes = [np.frombuffer(s, np.int32) for *_, s in found]
        params = train(
            np.frombuffer(b"".join(b for _, b, _ in found), np.int32).reshape(-1, 1 + len(STARTS)), np.concatenate(sizes),
            np.array([len(s) for s in sizes]), np.array([label for label, *_ in found], float),
        )
    held = docs.sparkSession.sparkContext.broadcast(params)
    out = rows.mapInArrow(_scoring(held, threshold), f"id {id_type}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
