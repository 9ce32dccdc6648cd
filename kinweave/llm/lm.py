"""Log-bilinear language model with noise-contrastive estimation, and unigram base scores.

The model predicts a token from the two before it. The MODELLED most frequent words and the end
of a text have vectors of their own; they are dealt into groups, and the probability of a word
is that of its group, given the two tokens before, times its own within the group, given the
same. So a token costs a product with the groups and one with a group's words, and both are
normalised. All other words share classes by a hash of their last bytes, as contexts and as
outcomes, and within a class a word has its smoothed share of the class's count: every token,
known or not, has a probability and these sum to one.

Counts are of all training texts. Noise-contrastive training, of groups and of words within
their group, goes over all training tokens: each task starts from the same parameters, sees its
texts once, and the results are averaged with the tasks' tokens as weights.

Texts are split and looked up once: what training and scoring read is a table of the ids of
their tokens. A text's different words are looked up, not all its words, some megabytes of text
at a time. Words that are not among the FREQUENT ones go into that table with their text's row
and meet their counts in a join.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.sampling import fold
from kinweave.workspace import Workspace

ALPHA = 0.1
#: Words with vectors of their own, at most; this bounds the parameters (some 140 bytes a word).
MODELLED = 1 << 14
#: Groups of these words, and classes that the other words share.
GROUPS, SHARED = 191, 64
END = GROUPS + SHARED  # the class of a text's end
CLASSES = END + 1
DIM = 16
BATCH, NOISE, WORD_NOISE, RATE = 4096, 32, 2, 0.1
#: Tokens scored at a time, and those whose outcomes are, which is what a core's cache holds.
HELD_TOKENS, SLICE = 1 << 18, 1 << 10
#: At most so many words, of FREQUENT_BYTES on average at most, are sent to every task with counts.
FREQUENT, FREQUENT_BYTES = 1 << 18, 40
#: Texts are split so many bytes at a time; a longer one by itself.
HELD_BYTES = 1 << 23
#: A task passes on its counts when it holds so many different words.
HELD_WORDS = 200_000
#: Parameters leave a task in pieces of so many numbers; tasks meet in so many sums first.
PIECE, FIRST_SUMS = 1 << 13, 64


def shared_class(word: bytes) -> int:
    return GROUPS + zlib.crc32(word[-2:]) % SHARED


def _split(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Some texts after the other, A-Z lower-cased: their different words, the place of each word
    among these, and where each text's words begin and end. Null texts have none."""
    texts = pc.fill_null(column, "")
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + HELD_BYTES, "right")) - 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at)))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words, place, bounds = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), bounds - bounds[0]
        empty = pc.index(words, b"").as_py()
        if empty >= 0:  # white space at an end of a text leaves an empty word there
            real = place != empty
            bounds, place = np.concatenate(([0], np.cumsum(real)))[bounds], place[real]
        yield words, place, bounds
        at = to


def _counting(batches):
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        if len(held) == 1:
            return held[0]
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": sums["word"], "n": sums["n_sum"]})

    for batch in batches:
        for words, place, _ in _split(batch.column(0)):
            n = np.bincount(place, minlength=len(words))
            held.append(pa.table({"word": words, "n": n}).filter(n > 0))
            if sum(map(len, held)) >= HELD_WORDS:
                held = [merged()]
                if 2 * len(held[0]) >= HELD_WORDS:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from merged().to_batches()


class Vocabulary:
    """Frequent words with counts, the ids of tokens, and the totals of each class.

    Ids are 0 .. n_words - 1 for modelled words, then the SHARED classes, then the end.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], shared: dict[int, tuple[int, int]], n_end: int, total: int, distinct: int) -> None:
        ranked = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.rank = {w: k for k, (w, _) in enumerate(ranked)}
        self.n_words = min(MODELLED, len(ranked))
        self.log_count = np.log10(np.array([n for _, n in ranked], float) + ALPHA)
        self.total, self.distinct, self.n_end = total, distinct, n_end
        self.word_count = np.array([n for _, n in ranked[:MODELLED]], float)
        self.class_count, self.class_words = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (n, words) in shared.items():
            self.class_count[GROUPS + k], self.class_words[GROUPS + k] = n, words
        for w, n in ranked[: self.n_words]:
            s = shared_class(w)
            self.class_count[s] -= n
            self.class_words[s] -= 1
        rest = [self.n_words + shared_class(w) - GROUPS for w, _ in ranked[self.n_words :]]
        self.id_of = np.concatenate((np.arange(self.n_words), rest)).astype(np.int32)
        group = np.arange(self.n_words) % GROUPS
        self.class_count[:GROUPS] = np.bincount(group, self.word_count, GROUPS)
        self.class_count[END] = n_end
        self.class_of = np.concatenate((group, np.arange(GROUPS, CLASSES))).astype(np.int32)
        # what a word's log10(c + ALPHA) loses within its class; nothing for a modelled one
        self.within = np.zeros(CLASSES)
        self.within[GROUPS:END] = np.log10(np.maximum(self.class_count[GROUPS:END], 0) + ALPHA * (self.class_words[GROUPS:END] + 1))
        self.noise = (self.class_count + 1.0) / (self.class_count + 1.0).sum()
        # within its group, a word's share
        self.share = (self.word_count + 1.0) / np.maximum(np.bincount(group, self.word_count + 1.0, GROUPS), 1.0)[group]
        self.by_group = np.lexsort((np.arange(self.n_words), group))
        self.group_start = np.searchsorted(group[self.by_group], np.arange(GROUPS + 1))
        self.size = np.diff(self.group_start).astype(np.int32)
        self.keep, self.other = self._places()

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """Walker's tables: as many equally likely places in a group as words, each of which holds
        its own word up to ``keep`` and the word ``other`` beyond; a word's parts are its share."""
        keep, other = np.ones(self.n_words), self.by_group.astype(np.int32)
        for low, high in zip(self.group_start.tolist(), self.group_start[1:].tolist()):
            size = (self.share[self.by_group[low:high]] * (high - low)).tolist()
            small = [i for i, x in enumerate(size) if x < 1]
            large = [i for i, x in enumerate(size) if x >= 1]
            while small and large:
                i, j = small.pop(), large[-1]
                keep[low + i], other[low + i] = size[i], self.by_group[low + j]
                size[j] -= 1 - size[i]
                if size[j] < 1:
                    small.append(large.pop())
        return keep, other

    def end(self) -> int:
        return self.n_words + SHARED

    def id_type(self) -> np.dtype:
        """The shortest unsigned number that holds every id."""
        return np.min_scalar_type(self.end())

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Places among the frequent words by count; -1 for other words."""
        return np.fromiter(map(self.rank.get, words, itertools.repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes], ranks: np.ndarray | None = None) -> np.ndarray:
        """The ids of a text's tokens, the end among them."""
        ranks = self.ranks(words) if ranks is None else ranks
        out = np.full(len(words) + 1, self.end(), np.int32)
        known = ranks >= 0
        out[:-1][known] = self.id_of[ranks[known]]
        first, crc = self.n_words, zlib.crc32
        for i in np.flatnonzero(~known).tolist():
            out[i] = first + crc(words[i][-2:]) % SHARED
        return out

    def draw(self, groups: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A word of each group, drawn by the words' shares."""
        at = rng.random(groups.shape) * self.size.take(groups)
        place = at.astype(np.int32)
        at -= place
        place += self.group_start.take(groups).astype(np.int32)
        return np.where(at < self.keep.take(place), self.by_group.take(place), self.other.take(place))


def start_parameters(vocabulary: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    eye, n = np.eye(DIM, dtype=np.float32), vocabulary.n_words
    return {
        "context": draw(n + SHARED + 1, DIM), "target": draw(CLASSES, DIM) * 0.1, "mix1": eye.copy(), "mix2": eye.copy() * 0.5,
        "bias": np.log(vocabulary.noise).astype(np.float32), "word": draw(n, DIM) * 0.1, "word_bias": np.log(vocabulary.share).astype(np.float32),
    }


def _by_value(index: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers under ``below``; short ones are sorted by their digits, which is faster."""
    return np.argsort(index.astype(np.int16) if below <= 1 << 15 else index, kind="stable")


def _summed(index: np.ndarray, rows: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The different indices, all under ``below``, and the sums of their rows.

    Rows have an even length: two numbers are added at a time, as parts of a complex one.
    """
    order = _by_value(index, below)
    at = index[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``; what lies far below zero has an infinite exponential and gives zero."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive Adagrad steps from shared start parameters.

    Vectors of outcomes are held in rows with their bias, which meets a one, and a zero, so that
    rows have an even length; the two mixing matrices are one under the other. ``p`` has the
    parameters by name, as views.
    """

    def __init__(self, params: dict[str, np.ndarray], vocabulary: Vocabulary, seed: int) -> None:
        self.word, self.target = (
            np.concatenate((params[k], params[b][:, None], np.zeros((len(params[k]), 1))), axis=1).astype(np.float32)
            for k, b in (("word", "word_bias"), ("target", "bias"))
        )
        self.context = params["context"].copy()
        self.mix = np.concatenate((params["mix1"], params["mix2"]))
        self.p = {
            "context": self.context, "target": self.target[:, :DIM], "mix1": self.mix[:DIM], "mix2": self.mix[DIM:],
            "bias": self.target[:, DIM], "word": self.word[:, :DIM], "word_bias": self.word[:, DIM],
        }
        self.squares = {k: np.full_like(getattr(self, k), 1e-2) for k in ("word", "target", "context", "mix")}
        self.v = vocabulary
        self.log_noise = np.log(NOISE * vocabulary.noise).astype(np.float32)
        self.log_share = np.log(WORD_NOISE * vocabulary.share).astype(np.float32)
        self.upto = np.cumsum(vocabulary.noise)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def _move(self, name: str, g: np.ndarray, n: int, at: np.ndarray | None = None) -> None:
        """By a gradient, which is overwritten; of the rows ``at``, or of all."""
        values, squares = getattr(self, name), self.squares[name]
        g *= np.float32(16 / n)
        square = g * g
        square += squares if at is None else squares.take(at, axis=0)
        g /= np.sqrt(square)
        g *= np.float32(RATE)
        if at is None:
            squares[:] = square
            values -= g
        else:
            squares[at] = square
            values[at] = np.subtract(values.take(at, axis=0), g, out=g)

    def step(self, c1: np.ndarray, c2: np.ndarray, y: np.ndarray) -> None:
        n = len(y)
        k = self.v.class_of.take(y)
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), CLASSES - 1)
        both = np.stack((c1, c2), axis=1)
        x = self.context.take(both, axis=0).reshape(n, 2 * DIM)
        q = np.zeros((n, DIM + 2), np.float32)
        np.matmul(x, self.mix, out=q[:, :DIM])
        q[:, DIM] = 1
        ry, rn = self.target.take(k, axis=0), self.target.take(drawn, axis=0)
        g_true = np.negative(_sigmoid(self.log_noise.take(k) - np.einsum("nd,nd->n", q, ry)))
        offset = rn.copy()
        offset[:, DIM] -= self.log_noise.take(drawn)
        g_noise = _sigmoid(q @ offset.T)
        dq = g_noise @ rn
        dq += np.multiply(ry, g_true[:, None], out=ry)
        target = np.zeros_like(self.target)
        at, rows = _summed(k, g_true[:, None] * q, CLASSES)
        target[at] = rows
        np.add.at(target, drawn, g_noise.T @ q)
        own = np.flatnonzero(y < self.v.n_words)
        if len(own):  # the word within its group
            qw, words = q.take(own, axis=0), np.empty((len(own), 1 + WORD_NOISE), np.int32)
            words[:, 0] = y.take(own)
            words[:, 1:] = self.v.draw(np.repeat(k.take(own), WORD_NOISE).reshape(-1, WORD_NOISE), self.rng)
            vectors = self.word.take(words, axis=0)
            g = _sigmoid(np.einsum("nkd,nd->nk", vectors, qw) - self.log_share.take(words))
            g[:, 0] -= 1
            dq[own] += np.einsum("nk,nkd->nd", g, vectors)
            rows = np.einsum("nk,nd->nkd", g, qw).reshape(-1, DIM + 2)
            at, rows = _summed(words.ravel(), rows, self.v.n_words)
            self._move("word", rows, n, at)
        dq = dq[:, :DIM]
        at, rows = _summed(both.ravel(), (dq @ self.mix.T).reshape(-1, DIM), len(self.context))
        mix = x.T @ dq
        self._move("context", rows, n, at)
        self._move("target", target, n)
        self._move("mix", mix, n)
        self.seen += n


def contexts(ids: np.ndarray, end: int, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each token; the end before the start.

    Texts may be laid end to end, each with its end, and begin at ``starts``.
    """
    c1 = np.concatenate(([end], ids[:-1])).astype(np.int32)
    c2 = np.concatenate(([end], c1[:-1])).astype(np.int32)
    c2[starts] = end
    return c1, c2


def _laid(column: pa.Array, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of some texts end to end, HELD_TOKENS at most or one text, and where texts begin."""
    column = column.cast(pa.large_binary())
    upto = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, int)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + HELD_TOKENS * kind.itemsize, "right")) - 1)
        yield data[upto[at] : upto[to]].view(kind).astype(np.int32), (upto[at:to] - upto[at]) // kind.itemsize
        at = to


def _training(held):
    def run(batches):
        vocabulary, params = held.value
        trainer = Trainer(params, vocabulary, 7)
        parts, size = [], 0

        def flush(all_of_it: bool):
            nonlocal parts, size
            if not size:
                return
            c1, c2, y = (np.concatenate(x) for x in zip(*parts))
            whole = len(y) if all_of_it else len(y) // BATCH * BATCH
            for at in range(0, whole, BATCH):
                trainer.step(*(x[at : min(at + BATCH, whole)] for x in (c1, c2, y)))
            parts, size = [(c1[whole:], c2[whole:], y[whole:])], len(y) - whole

        for batch in batches:
            for ids, starts in _laid(batch.column(0), vocabulary.id_type()):
                parts.append((*contexts(ids, vocabulary.end(), starts), ids))
                size += len(ids)
                if size >= 64 * BATCH:
                    flush(False)
        flush(True)
        if trainer.seen:
            flat = np.concatenate([trainer.p[k].ravel() for k in sorted(trainer.p)]).astype(np.float64) * trainer.seen
            cut = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
            cols = [pa.array(range(len(cut)), pa.int32()), pa.array([float(trainer.seen)] * len(cut)), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["piece", "weight", "sums"])

    return run


def _added(group: pa.Table) -> pa.Table:
    """The sum of the pieces of a group; each is added in turn."""
    total = None
    for batch in group.select(["sums"]).to_batches():
        for blob in batch.column(0):
            part = np.frombuffer(blob.as_py(), np.float64)
            total = part.copy() if total is None else total + part
    keys = [c for c in ("piece", "part") if c in group.column_names]
    weight = float(np.sum(group["weight"].to_numpy()))
    return pa.table({**{k: group[k].slice(0, 1) for k in keys}, "weight": [weight], "sums": pa.array([total.tobytes()], pa.binary())})


def averaged(trained: DataFrame, params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the tasks' parameters by their tokens, summed in two rounds; ``params`` if there are none."""
    first = trained.withColumn("part", F.pmod(F.xxhash64("sums"), F.lit(FIRST_SUMS)).cast("int")).groupBy("piece", "part")
    sums = first.applyInArrow(_added, "piece int, part int, weight double, sums binary").drop("part")
    found = sums.groupBy("piece").applyInArrow(_added, "piece int, weight double, sums binary").collect()
    if not found:
        return params
    flat = np.concatenate([np.frombuffer(r.sums, np.float64) / r.weight for r in sorted(found, key=lambda r: r.piece)])
    out, at = {}, 0
    for k in sorted(params):
        out[k] = flat[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
        at += params[k].size
    return out


class Model:
    """Normalised log10 probabilities of tokens after pairs of tokens."""

    def __init__(self, vocabulary: Vocabulary, params: dict[str, np.ndarray]) -> None:
        self.v = vocabulary
        # the ones that meet a bias come with the nearer context
        one = params["context"] @ params["mix1"]
        self.one = np.concatenate((one, np.ones((len(one), 1), np.float32)), axis=1)
        self.two = np.concatenate((params["context"] @ params["mix2"], np.zeros((len(one), 1), np.float32)), axis=1)
        self.classes = np.concatenate((params["target"], params["bias"][:, None]), axis=1)
        self.target = self.classes.T.copy()
        word = np.concatenate((params["word"], params["word_bias"][:, None]), axis=1)[vocabulary.by_group]
        self.words = [word[a:b].T.copy() for a, b in zip(vocabulary.group_start, vocabulary.group_start[1:])]
        self.place = np.zeros(vocabulary.n_words, np.int64)  # of a word in its group
        group = np.arange(vocabulary.n_words) % GROUPS
        self.place[vocabulary.by_group] = np.arange(vocabulary.n_words) - vocabulary.group_start[group[vocabulary.by_group]]

    def log10(self, c1: np.ndarray, c2: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the class, and for a modelled word of the word. Contexts that recur are looked at once."""
        v = self.v
        _, first, again = np.unique(c1 * np.int64(len(self.one)) + c2, return_index=True, return_inverse=True)
        q, k = self.one.take(c1[first], axis=0) + self.two.take(c2[first], axis=0), v.class_of[y]
        total = np.empty(len(q))
        for at in range(0, len(q), SLICE):
            total[at : at + SLICE] = _log_total(q[at : at + SLICE] @ self.target)
        q = q.take(again, axis=0)
        out = np.einsum("nd,nd->n", q, self.classes.take(k, axis=0)).astype(np.float64) - total[again]
        own = np.flatnonzero(y < v.n_words)
        own = own[_by_value(k[own], CLASSES)]
        cuts = np.searchsorted(k[own], np.arange(GROUPS + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows = own[cuts[g] : cuts[g + 1]]
            for at in range(0, len(rows), SLICE):
                some = rows[at : at + SLICE]
                logits = q.take(some, axis=0) @ self.words[g]
                picked = logits[np.arange(len(some)), self.place[y[some]]].astype(np.float64)
                out[some] += picked - _log_total(logits)
        return out / math.log(10)


def _log_total(logits: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials; overwrites ``logits``."""
    most = 0.0
    if logits.max() > 60:  # exponentials stay in range and their sums above zero
        most = logits.max(axis=1, keepdims=True)
        logits -= most
        most = most[:, 0].astype(np.float64)
    return most + np.log((np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)).astype(np.float64))


def _encoding(held):
    def run(batches):
        vocabulary = held.value
        norm = math.log10(vocabulary.total + ALPHA * (vocabulary.distinct + 1))
        end = math.log10(vocabulary.n_end + ALPHA)
        log_count = np.append(vocabulary.log_count, 0.0)  # the last is that of rank -1
        kind = vocabulary.id_type()
        for batch in batches:
            at = 0
            for words, place, bounds in _split(batch.column(2)):
                n, listed = len(bounds) - 1, words.to_pylist()
                ranks = vocabulary.ranks(listed)
                text = np.repeat(np.arange(n), np.diff(bounds))
                starts = bounds[:-1] + np.arange(n)
                inner = np.ones(len(place) + n, bool)
                inner[bounds[1:] + np.arange(n)] = False

                def tokens(of_word: np.ndarray, of_end, kind) -> np.ndarray:
                    out = np.full(len(inner), of_end, kind)
                    out[inner] = of_word.astype(kind).take(place)
                    return out

                sums = lambda *x: np.add.reduceat(tokens(*x), starts)
                ids = tokens(vocabulary.ids(listed, ranks)[:-1], vocabulary.end(), kind)
                cuts = np.append(starts, len(ids)).astype(np.int32) * np.int32(kind.itemsize)
                logs = log_count[ranks]
                unknown = np.flatnonzero((ranks < 0).take(place)) if len(place) else place
                found, times = np.unique(text[unknown] * np.int64(len(words)) + place[unknown], return_counts=True)
                lists = pa.array(np.searchsorted(found, np.arange(n + 1) * len(words)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(bounds) + 1),
                        pa.array(sums(ranks >= 0, vocabulary.n_end > 0, np.int64)),
                        pa.array(sums(logs, end, float) - norm * (np.diff(bounds) + 1)),
                        pa.array(sums(np.where(ranks >= vocabulary.n_words, logs, 0.0), 0.0, float)),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(ids)]),
                        pa.ListArray.from_arrays(lists, words.take(pa.array(found % max(len(words), 1)))),
                        pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "ids", "rare", "rare_n"],
                )
                at += n

    return run


def _scoring(held):
    def run(batches):
        vocabulary, params = held.value
        model = Model(vocabulary, params)
        within = vocabulary.within[vocabulary.class_of]
        for batch in batches:
            sums = []
            for ids, starts in _laid(batch["ids"], vocabulary.id_type()):
                c1, c2 = contexts(ids, vocabulary.end(), starts)
                parts = (slice(at, at + HELD_TOKENS) for at in range(0, len(ids), HELD_TOKENS))
                value = np.concatenate([model.log10(c1[part], c2[part], ids[part]) for part in parts])
                sums.append(np.add.reduceat(value - within[ids], starts))
            score = batch["score"].to_numpy() + np.concatenate([*sums, np.zeros(0)])
            columns = [c for c in batch.schema.names if c not in ("ids", "score")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(score)], [*columns, "score"])

    return run


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """All words above a count that at most FREQUENT words of FREQUENT_BYTES on average reach."""
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    least, words, size = None, 0, 0
    for b in bins.orderBy(F.desc("level")).collect():  # a few hundred rows, whatever the vocabulary
        words, size = words + b.words, size + b.bytes
        if words > FREQUENT or size > FREQUENT * FREQUENT_BYTES:
            break
        least = b.level
    if least is None:
        return []
    return [(bytes(r.word), r.n) for r in counts.where(level >= least).toArrow().to_pandas().itertuples(index=False)]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0) -> DataFrame:
    """Log10 probabilities of whole texts: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A-Z are lower-cased; tokens are maximal runs without ASCII white space and one end. Rows of
    the held fold, by the crc32 of the id, are scored and teach nothing; a row without an id
    counts as held out. ``base_score`` is a unigram with ALPHA added to each count, ``score``
    is the model's. A null or empty text is its end alone, in training too. Repeated rows count
    as often as they occur. Where nothing was learned from, counts are zero and the model is
    uniform over its classes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).alias("text")
    )
    taught = rows.where(~F.col("held_out"))
    counted = taught.select("text").mapInArrow(_counting, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = work.table(counted, "counts")
    n_end = taught.count()
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    last = F.substring("word", -2, 2)
    shared = counts.groupBy(F.pmod(F.crc32(last), F.lit(SHARED)).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    vocabulary = Vocabulary(
        _frequent(counts), {r.k: (r.n, r.v) for r in shared.collect()}, n_end,
        (totals[0] or 0) + n_end, totals[1] + (n_end > 0),
    )
    encoded = rows.withColumn("row", F.monotonically_increasing_id()).select(
        F.struct("id", "row").alias("id"), "held_out", "text"
    ).mapInArrow(
        _encoding(spark.sparkContext.broadcast(vocabulary)),
        f"id struct<id:{id_type},row:long>, held_out boolean, n_tokens long, n_known long, base_score double, "
        "score double, ids binary, rare array<binary>, rare_n array<long>",
    )
    encoded = work.table(encoded, "encoded")
    params = start_parameters(vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, params))
    trained = encoded.where(~F.col("held_out")).select("ids").mapInArrow(_training(sent), "piece int, weight double, sums binary")
    params = averaged(trained, params)
    scored = encoded.drop("rare", "rare_n").mapInArrow(
        _scoring(spark.sparkContext.broadcast((vocabulary, params))),
        f"id struct<id:{id_type},row:long>, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    scored = work.table(scored, "scored")
    rare = encoded.select(F.col("id.row").alias("row"), F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times")
    )
    value = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(value).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, F.col("id.row") == F.col("row"), "left").select(
        F.col("id.id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
