"""Words of whole texts as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as a run of characters other than those. Texts are laid end to end in chunks of
bounded size; a text longer than a chunk has one of its own, and its bytes are hashed in
slices, so that what is held besides the text is a few numbers for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)[:n]


@dataclass
class Chunk:
    """Some whole texts laid end to end, each followed by one space."""

    first: int  # the index of the first text
    data: np.ndarray  # bytes
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    text_starts: np.ndarray  # bytes of text i are text_starts[i]:text_starts[i + 1]

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.bounds))


def _chunk(first: int, texts: list[bytes]) -> Chunk:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return Chunk(first, data, starts, ends, np.searchsorted(starts, text_starts), text_starts)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < limit):
            held += len(texts[to]) + 1
            to += 1
        yield _chunk(at, texts[at:to])
        at = to


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    table = powers(int((ends - starts).max()))
    for at in range(0, len(starts), step):
        s, e = starts[at : at + step], ends[at : at + step]
        lens = e - s
        cuts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(int(lens.sum())) - np.repeat(cuts, lens)
        value = (data[place + np.repeat(s, lens)].astype(np.uint64) + np.uint64(1)) * table[place]
        out[at : at + step] = mix(np.add.reduceat(value, cuts) + lens.astype(np.uint64))
    return out


class Windows:
    """Hashes of word windows of any length from one prefix sum modulo 2**64."""

    _Q = np.uint64(0xD1342543DE82EF95)
    _QINV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

    def __init__(self, words: np.ndarray) -> None:
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words), self._Q), out=self.prefix[1:])
        self.inverse = powers(len(words) + 1, self._QINV)

    def at(self, place: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` words that start at ``place``."""
        raw = (self.prefix[place + length] - self.prefix[place]) * self.inverse[place]
        return mix(raw + np.uint64(length))
