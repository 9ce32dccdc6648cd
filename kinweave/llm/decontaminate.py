"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.bytetok import to_bytes
from kinweave.workspace import Workspace

MATCH, MISMATCH, GAP = 2, -1, -1
#: Test items go out in blocks of about this much text, each held against all documents.
BLOCK_BYTES = 8 << 20
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Letters of scripts that are written without spaces: Thai to Myanmar, Khmer, kana, Han.
_ALONE = re.compile("([\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_ONE = 1 << 24  # a point of the score, next to which matching words are counted


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; what is beyond ASCII counts as a letter.

    A character of a script without spaces is a token of its own.
    """
    low = (text or "").lower()
    if not low.isascii():
        low = _ALONE.sub(r" \1 ", low)
    return to_bytes(low).translate(_FOLD).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two integer sequences: score, matching words, end in passage."""
    ramp = -GAP * _ONE * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for token in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(passage == token, MATCH * _ONE + 1, MISMATCH * _ONE), above[1:] + GAP * _ONE)
        row[row < _ONE] = 0
        above = np.maximum.accumulate(row + ramp) - ramp
        above[above < _ONE] = 0
        if (top := int(above.max())) > best:
            best, end = top, int(above.argmax())
    return best // _ONE, best % _ONE, end


class Seeds:
    """The test items of one block, with their rare n-grams.

    ``found`` tells in how many of all items, of whatever block, a word is, and up to
    ``limit`` items make a word rare.
    """

    def __init__(self, items: list[tuple], found: dict[bytes, int], limit: int, n: int) -> None:
        self.n = n
        self.items = [(key, words) for key, text in items if (words := tokens(text))]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in self.items for w in words}))}
        self.coded = [np.array([self.vocabulary[w] for w in words]) for _, words in self.items]
        self.counts = [Counter(c.tolist()) for c in self.coded]
        self.seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[bytes, set[int]] = defaultdict(set)  # and how long their seeds are
        for k, (_, words) in enumerate(self.items):
            size = min(n, len(words))
            grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
            rare = [i for i, g in enumerate(grams) if min(found[w] for w in g) <= limit]
            for i in rare or range(len(grams)):
                self.seeds[grams[i]].append((k, i))
                self.anchors[min(grams[i], key=lambda w: (found[w], w))].add(size)
        self.seeds, self.anchors = dict(self.seeds), dict(self.anchors)

    def matches(self, text: str | None, threshold: float, min_words: int) -> list[tuple]:
        """(item, score, first word, word after the last) of the items found in a text."""
        words = tokens(text)
        anchors, seeds = self.anchors, self.seeds
        starts = sorted({
            (j, size) for i, w in enumerate(words) if w in anchors for size in anchors[w]
            for j in range(max(0, i - size + 1), min(i, len(words) - size) + 1)
        })
        diagonals: dict[int, set[int]] = defaultdict(set)
        for j, size in starts:
            for k, i in seeds.get(tuple(words[j : j + size]), ()):
                diagonals[k].add(j - i)
        found = []
        for k, lines in diagonals.items():
            size = len(self.coded[k])
            slack = size // 4 + 3
            # a short item must be there word for word
            needed = MATCH * size * (threshold if size >= min_words else 1)
            least = min(size, min_words)
            best = None
            for lo, hi in _spans(sorted(lines), size, slack, len(words)):
                passage = np.array([self.vocabulary.get(w, -1) for w in words[lo:hi]])
                shared = (Counter(passage.tolist()) & self.counts[k]).total()
                if MATCH * shared < needed or shared < least:
                    continue
                score, same, end = align(self.coded[k], passage)
                if score >= needed and same >= least and (best is None or score > best[1]):
                    best = (self.items[k][0], score, max(0, lo + end - size), lo + end, MATCH * size)
            if best:
                found.append((best[0], best[1] / best[4], best[2], best[3]))
        return found


def _spans(lines: list[int], size: int, slack: int, n_words: int):
    """Stretches of words around the diagonals, merged where they meet."""
    lo = hi = None
    for d in lines:
        a, b = max(0, d - slack), min(n_words, d + size + slack)
        if hi is not None and a <= hi - slack:
            hi = b
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    n: int = 3,
    rare_share: float = 0.01,
    min_words: int = 8,
) -> DataFrame:
    """Documents with a passage that aligns with a test item.

    Returns ``(id, item_id, score, first_word, end_word)`` with one row for each input row
    and item found in it. A seed is an n-gram of an item with a word that at most
    ``rare_share`` of all items (two at least) have; an item without one uses all its
    n-grams. Rarity is measured among the test items, so that an item which leaked into very
    many documents keeps its seeds. The score is that of the best local alignment over that
    of the whole item with itself; an item is found at ``threshold`` or more, with
    ``min_words`` matching words at least. Positions count normalised words.

    An item with fewer words than ``min_words`` is found where all of it stands word for
    word; one without any word never is. Null texts have no words. Repeated rows give
    repeated results; null ids are kept. Without items, or without documents, there are no
    rows. Each block of items is broadcast, and its size is bounded; a larger benchmark takes
    more blocks, not larger ones, and gives the same rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, score double, first_word long, end_word long"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size, n_items = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).first()
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int").alias("block")
    words = items.select(block, "text").mapInArrow(_vocabulary, "block int, word binary")
    counts = words.groupBy("word").agg(F.count("*").cast("int").alias("n"), F.collect_set("block").alias("blocks"))
    counts = work.table(counts, "counts")
    limit = max(2, math.floor(rare_share * n_items))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for b in range(blocks):
        held = sorted(((r.item, r.text) for r in items.where(block == b).collect()), key=repr)
        found = {bytes(r.word): r.n for r in counts.where(F.array_contains("blocks", b)).select("word", "n").collect()}
        sent = spark.sparkContext.broadcast((held, found, limit))
        part = rows.mapInArrow(_matcher(sent, threshold, n, min_words), schema)
        if blocks > 1:  # one block after the other is held by the driver and the tasks
            part = work.table(part, f"block-{b}")
            sent.destroy()
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", "first_word", "end_word")


def _vocabulary(batches):
    """The different words of each item."""
    for batch in batches:
        found = [(b, w) for b, text in zip(*(c.to_pylist() for c in batch.columns)) for w in sorted(set(tokens(text)))]
        blocks, words = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(words, pa.binary())], ["block", "word"])


def _matcher(held, threshold: float, n: int, min_words: int):
    def run(batches):
        items, found, limit = held.value
        seeds = Seeds(items, found, limit, n)
        for batch in batches:
            ids, out = batch.column(0), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                out += [(row, *m) for m in seeds.matches(text, threshold, min_words)]
            if out:
                where, item, score, first, end = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(where)), pa.array(item), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    ["id", "item", "score", "first_word", "end_word"],
                )

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
