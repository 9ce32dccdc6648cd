"""Spelling variants: words one edit apart, each led to the form that is most frequent.

One edit leaves the first or the second half of a word as it is. So a word meets all words that
start with its first half, or end with its second, under a key made of that half; words of
neighbouring lengths come under the keys that a word of each length near theirs would have.
Keys are dealt to partitions. Each builds a minimal automaton of the words that came, and one
of the reversed words; it matches the half exactly, completes the rest with one error, and
reads the word's number along the path. What both directions find is counted once.

Keys under which too many words meet are split: the half with the error is halved again, and
what is outside of it is matched exactly. Where the error's place is known to a letter, no more
words can meet than there are letters, or pairs of them. So a partition's size is bounded
whatever the words, and nothing is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.llm.automaton import Automaton
from kinweave.llm.bytetok import to_bytes, word_hashes
from kinweave.workspace import Workspace

#: Bytes of text whose words are counted at a time, and words that a task holds counts of.
COUNTED_BYTES, HELD_WORDS = 4 << 20, 1 << 18
#: Keys with more words are split; and words in a partition, about.
MOST_OF_KEY, PARTITION_WORDS = 8192, 1 << 16
#: Words looked up at a time.
STEP = 1 << 13

_LEAD = 0xC3  # of the UTF-8 of U+00C0 to U+00FF, and of these alone


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes after a prefix with the crc32 ``before``."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, 64), kind="stable")
    state, start = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), starts[order]
    active = np.searchsorted(-length[order].clip(max=64), -np.arange(64), side="left")
    for place in range(64):
        m = int(active[place])
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ data[start[:m] + place]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(data[starts[i] + 64 : ends[i]].tobytes(), int(out[i]))
    return out


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data in lower case, starts, ends, text) of the runs of letters."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
    folded = data | np.uint8(0x20)
    ascii_letter = (folded >= 0x61) & (folded <= 0x7A)
    data[ascii_letter] = folded[ascii_letter]
    inside = ascii_letter | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def _without_one(word: bytes, h: int) -> str:
    letters = word.decode()
    at = h % len(letters)
    return letters[:at] + letters[at + 1 :]


def _tally(held: dict[str, int], ids: list[str], texts: list[bytes], typos: int, least: int) -> None:
    """Add the words of some texts to the counts."""
    data, starts, ends, text = _runs(texts)
    if not len(starts):
        return
    hit = np.zeros(len(starts), bool)
    if typos:
        prefixes = np.array([zlib.crc32(f"{i}:".encode("utf-8", "surrogatepass")) for i in ids], np.uint32)
        h = _crcs(data, starts, ends, prefixes[text])
        hit = h % np.uint32(typos) == 0
        for i in np.flatnonzero(hit):
            word = _without_one(data[starts[i] : ends[i]].tobytes(), int(h[i]))
            if len(word) >= least:
                held[word] = held.get(word, 0) + 1
    rest = np.flatnonzero(~hit & (ends - starts >= least))
    _, model, times = np.unique(word_hashes(data, starts[rest], ends[rest]), return_index=True, return_counts=True)
    for i, n in zip(rest[model].tolist(), times.tolist()):
        word = data[starts[i] : ends[i]].tobytes().decode()
        if len(word) >= least:
            held[word] = held.get(word, 0) + n


def _counting(typos: int, least: int):
    def told(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        ids: list[str] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                ids.append(i or "")
                texts.append(to_bytes(text.as_py()))
                size += len(texts[-1]) + 1
                if size >= COUNTED_BYTES:
                    _tally(held, ids, texts, typos, least)
                    ids, texts, size = [], [], 0
                    if len(held) >= HELD_WORDS:
                        yield told(held)
                        held = {}
        _tally(held, ids, texts, typos, least)
        yield told(held)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int = 0, least_length: int = 5) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, of at least so many letters.

    A-Z alone become lower case. With ``typos``, a run loses a letter where that number divides
    h, the crc32 of ``<id>:<run in lower case>``: the letter at h modulo the run's length. A null
    id is the empty text there. Null and empty texts have no words; repeated rows count as often
    as they come; other columns are ignored. Runs of four MB of text are told apart by 64-bit
    hashes before they are counted by what they are.
    """
    rows = docs.select(docs[id_col].cast("string").alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(_counting(typos, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows whose error lies in the letters ``low`` to ``high``, with either half of these.

    ``size`` is the length of the words that ask; ``key`` what such a word has outside.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    either = F.explode(F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high"))))
    cut = rows.withColumn("_half", either).select("word", "n", "size", F.col("_half.low").alias("low"), F.col("_half.high").alias("high"))
    outside = F.concat(F.left(F.col("word"), F.col("low")), F.lit("|"), F.right(F.col("word"), F.col("size") - F.col("high")))
    return cut.withColumn("key", outside)


def _keyed(words: DataFrame, work: Workspace) -> DataFrame:
    """Every word under the keys of words one edit away, no key with many words."""
    length = F.char_length("word")
    sizes = F.explode(F.array(length - 1, length, length + 1)).alias("size")
    pending = _halved(words.select("word", "n", sizes).select("*", F.lit(0).alias("low"), F.col("size").alias("high")))
    settled = []
    for level in range(64):  # lengths halve, so they end long before
        table = work.table(pending, f"level-{level}")
        wide = F.col("high") - F.col("low") > 1
        hot = work.table(table.where(wide).groupBy("key").count().where(F.col("count") > MOST_OF_KEY).select("key"), f"hot-{level}")
        if hot.isEmpty():
            settled.append(table)
            break
        asked = table.join(hot.withColumn("_hot", F.lit(True)), "key", "left")
        settled.append(asked.where(F.col("_hot").isNull() | ~wide).select(*table.columns))
        pending = _halved(asked.where(F.col("_hot") & wide))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words among those of a partition."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.concat_tables(parts).to_pydict()
    for forward in (True, False):
        some = [i for i, k in enumerate(rows["key"]) if k.startswith("|") != forward]
        words = [rows["word"][i] if forward else rows["word"][i][::-1] for i in some]
        times = dict(zip(words, (rows["n"][i] for i in some)))
        listed = sorted(times)
        if len(listed) < 2:
            continue
        automaton = Automaton(listed)
        counts = np.array([times[w] for w in listed])
        asks = [(w, rows["low"][i] if forward else rows["size"][i] - rows["high"][i]) for w, i in zip(words, some) if rows["size"][i] == len(w)]
        spelled = np.array([w if forward else w[::-1] for w in listed], object)
        for at in range(0, len(asks), STEP):
            step = asks[at : at + STEP]
            which, number = automaton.one_error([w for w, _ in step], np.array([e for _, e in step]))
            asking = np.array([w if forward else w[::-1] for w, _ in step], object)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asking[which], pa.string()), pa.array(spelled[number], pa.string()), pa.array(counts[number], pa.int64())], ["word", "near", "near_n"]
            )


def near_words(words: DataFrame, work: Workspace) -> DataFrame:
    """(word, near, near_n) for all two words of ``words(word, n)`` that are one edit apart, both ways.

    An edit inserts, deletes or replaces a code point. Words are distinct, and not empty.
    """
    keyed = work.table(_keyed(words, work), "keyed")
    partitions = max(-(-keyed.count() // PARTITION_WORDS), words.sparkSession.sparkContext.defaultParallelism)
    found = keyed.repartition(partitions, "key").mapInArrow(_nearby, "word string, near string, near_n long")
    return found.distinct()


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) of words with a form: forms are followed, twice as far each round."""
    now = work.table(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 64):
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = now.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = work.table(told, f"roots-{k}")
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words in ``words(word string, n long)``.

    A word's form is its near word with the largest ``n`` (in a tie the least in code-point
    order), if that is ``ratio`` times the word's or more, else null. The root is where forms
    lead in the end, the word itself if it has none. Rows of one word are added up; null and
    empty words are left out, and so are other columns. ``ratio`` is over 1, so forms never
    lead back. Time and memory grow with the longest word.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    work = Workspace(words.sparkSession, "spelling")
    words = work.table(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best: Column = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = work.table(near_words(words, work).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    led = F.col("best.near_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(led, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.near_n")).alias("form_n")
    )
    found = work.table(found, "found")
    roots = _roots(found.where("form is not null"), work)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of at least five letters and three occurrences, with one typo in 97 runs."""
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), typos=97)
    return variants(counts.where("n >= 3"))
