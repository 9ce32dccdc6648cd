"""Byte-level BPE: texts to token ids by ranked merges, and ids back to texts.

The symbols of a pre-token are a doubly linked list. Every pair of neighbours with a merge
goes on a priority queue, ordered by the merge's rank and then by place; an entry is stale,
and skipped, if its pair is not what stands at its place when it comes up. Decoding
concatenates the byte strings of the vocabulary.

Each pre-token is merged once and kept, in a table of bounded size in each Python worker. The
vocabulary, a file of some megabytes, is read by the driver and broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: A worker keeps so many pre-tokens of up to KEPT_LENGTH characters, then starts anew.
KEPT, KEPT_LENGTH = 600_000, 64
#: Pre-tokens that are held at a time, and characters of text in an Arrow batch of ids.
STEP, BATCH_CHARS = 1 << 16, 4 << 20
#: Largest vocabulary file that is broadcast.
MOST_FILE_BYTES = 64 << 20

# Letters and numbers of Unicode 16.0, by which the pattern tells classes apart,
# that Unicode 15.1 does not have.
_NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
_NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
# White space, and English endings that are split off.
_SPACES = "9-D 20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _code_points(ranges: str) -> Iterator[int]:
    for part in ranges.split():
        low, _, high = part.partition("-")
        yield from range(int(low, 16), int(high or low, 16) + 1)


def _class(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"\\U{part[0]:08x}-\\U{part[-1]:08x}" for part in np.split(np.array(points), cuts))


@functools.cache
def splitter(limit: int) -> re.Pattern:
    """The pattern that splits texts whose code points are all below ``limit``."""
    spaces = set(_code_points(_SPACES))
    found: dict[str, set[int]] = {"L": set(_code_points(_NEW_LETTERS)), "N": set(_code_points(_NEW_NUMBERS)), "Z": spaces}
    for c in range(limit):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN" and c not in spaces:
            found[kind].add(c)
    letter, number, space = (_class(sorted(c for c in found[k] if c < limit)) for k in "LNZ")
    endings = f"'(?:{'|'.join(_ENDINGS)})"
    return re.compile(
        f" ?+[{letter}]++| ?+[{number}]++|{endings}| ?+[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+"
    )


def pretokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text in order, in lists of up to STEP."""
    try:
        text.encode("latin-1")
        limit = 0x100
    except UnicodeEncodeError:
        limit = 0x10000 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 0x110000
    pattern = splitter(limit)
    if len(text) <= 4 * STEP:
        yield pattern.findall(text)
        return
    held = []
    for m in pattern.finditer(text):
        held.append(m[0])
        if len(held) == STEP:
            yield held
            held = []
    yield held


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable ones for themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The merges and byte strings of a tokenizer file.

    The file is the JSON of a byte-level BPE without normaliser, added prefix space or dropout.
    Added tokens are found in a text before it is split, the longest first.
    """

    def __init__(self, content: bytes) -> None:
        told = json.loads(content)
        model, pre = told["model"], told["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or told["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.bytes: dict[int, bytes] = {i: self._spelled(t, letters) for t, i in ids.items()}
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}  # by pair, the left id shifted by 32
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] << 32 | ids[right]] = rank
            self.made.append(ids[left + right])
        added = told.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take their surroundings are not known here")
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes |= {t["id"]: self._spelled(t["content"], letters) for t in added}
        found = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.find_added = re.compile(f"({found})") if found else None
        self.strings = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.kept = _Kept(self)

    @staticmethod
    def _spelled(token: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        rank_of, made, n = self.ranks.get, self.made, len(piece)
        ids = [self.of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [rank * n + at for at, pair in enumerate(zip(ids, ids[1:])) if (rank := rank_of(pair[0] << 32 | pair[1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            right = after[at]
            # stale: nothing follows, it was taken into its left neighbour, or one of the two has grown
            if right == n or ids[at] < 0 or rank_of(ids[at] << 32 | ids[right]) != rank:
                continue
            ids[at] = new = made[rank]
            ids[right] = -1
            follow = after[at] = after[right]
            if follow < n:
                before[follow] = at
                if (rank := rank_of(new << 32 | ids[follow])) is not None:
                    heapq.heappush(queue, rank * n + at)
            ahead = before[at]
            if ahead >= 0 and (rank := rank_of(ids[ahead] << 32 | new)) is not None:
                heapq.heappush(queue, rank * n + ahead)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Token ids of a text, each as four bytes, the least first."""
        out = []
        parts = self.find_added.split(text) if self.find_added else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(_packed([self.added[part]]))
            elif part:
                out += (b"".join(map(self.kept.__getitem__, pieces)) for pieces in pretokens(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD, ids without a string nothing."""
        known = ids if not len(ids) or 0 <= ids.min() <= ids.max() < len(self.strings) else ids[(ids >= 0) & (ids < len(self.strings))]
        return b"".join(map(self.strings.__getitem__, known.tolist())).decode("utf-8", "replace")


class _Kept(dict):
    """Packed ids by pre-token, merged when first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = _packed(self.vocabulary.merged(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Shared:
    """A vocabulary file for the tasks of a job; a worker parses it once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read(MOST_FILE_BYTES + 1)
        if len(content) > MOST_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
        Vocabulary(content)  # tells what is wrong with it here
        self.digest, self.content = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def get(self) -> Vocabulary:
        if self.digest not in _PARSED:
            _PARSED.clear()
            _PARSED[self.digest] = Vocabulary(self.content.value)
        return _PARSED[self.digest]


#: The vocabulary that this worker used last, by the digest of its file.
_PARSED: dict[str, Vocabulary] = {}


def _parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a column each."""
    sizes = batch.column(column)
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64 if pa.types.is_large_string(sizes.type) or pa.types.is_large_list(sizes.type) else np.int32)[sizes.offset : sizes.offset + len(sizes) + 1])
    group = np.cumsum(lengths) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high > low:
            yield batch.slice(low, high - low)


def _encoding(shared: _Shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        for whole in batches:
            for batch in _parts(whole, text, BATCH_CHARS):
                coded = [vocabulary.encode(t or "") for t in batch.column(text).to_pylist()]
                lengths = np.array([len(c) // 4 for c in coded], np.int32)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                rest = [batch.column(c) for c in batch.schema.names if c != text]
                names = [c for c in batch.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lengths.astype(np.int64)), ids], [*names, "n_tokens", "ids"])

    return run


def _rows_of(ids: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row; a null row and null ids count as none."""
    values, offsets = ids.values, ids.offsets.to_numpy()
    for k in range(len(ids)):
        row = values.slice(offsets[k], offsets[k + 1] - offsets[k]) if ids[k].is_valid else values.slice(0, 0)
        yield row.drop_null().to_numpy() if row.null_count else row.to_numpy()


def _decoding(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        for whole in batches:
            for batch in _parts(whole, "ids", BATCH_CHARS):
                texts = pa.array([vocabulary.decode(row) for row in _rows_of(batch.column("ids"))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of each row, ``ids`` an array of ints.

    ``path`` is a tokenizer file that the driver can read. Texts are taken whole; a null or
    empty text has no tokens. The string of an added token in a text becomes that token, as
    the file's own library has it. Null ids and repeated rows are kept, one row out for each
    row in; other columns are ignored, whatever their names.
    """
    shared = _Shared(docs.sparkSession, path)
    from_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(_encoding(shared, "_text"), f"_id {from_type}, n_tokens long, ids array<int>").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with a column ``decoded``: the text of its column ``ids``, an array of ints.

    Null ids, and ids that the vocabulary lacks, stand for nothing; a null or empty array is an
    empty text. Bytes that are no UTF-8 become U+FFFD. There must be no column ``decoded`` yet.
    """
    shared = _Shared(tokens.sparkSession, path)
    return tokens.mapInArrow(_decoding(shared), StructType([*tokens.schema.fields]).add("decoded", "string"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in _rows_of(batch.column("ids"))]
        texts = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("n_tokens"), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again with the public byte-level vocabulary of 50,257 ids.

    What :func:`encode` and :func:`decode` do is done in one Python worker here, so ids and
    texts do not go back and forth.
    """
    import public_tokenizers

    shared = _Shared(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    coded, decoded = _encoding(shared, "_text"), _decoding(shared)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _digests(decoded(coded(batches))), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
