"""Name similarity, the one part of scoring that needs a greedy choice; all pairs of an Arrow batch at once.

``jaro`` to ``name_similarity`` say what is computed, a pair at a time; what Spark calls are the
numpy forms below them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinweave.functions.text import SOUND_RULES, TOKEN_ALIASES


@lru_cache(maxsize=100_000)
def key_of(token: str) -> str:
    word = re.sub("[^a-z]", "", token.lower())
    word = TOKEN_ALIASES.get(word, word)
    for old, new in SOUND_RULES:
        word = word.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", word[:1] + re.sub("[aeiouy]", "", word[1:]))


def jaro(a: str, b: str) -> float:
    """Jaro similarity with half-transpositions counted as halves."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    from_a = []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        try:
            at = free.index(c, lo, i + reach + 1)
        except ValueError:
            continue
        from_a.append(c)
        free[at] = ""
    if not from_a:
        return 0.0
    from_b = [c for c, left in zip(b, free) if not left]
    m = len(from_a)
    half = sum(map(str.__ne__, from_a, from_b)) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    base = jaro(a, b)
    same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
    return base + same * boost * (1 - base)


@lru_cache(maxsize=500_000)
def token_similarity(a: str, b: str) -> float:
    """0.9 for an initial and a token that begins with it; 0.95 at least for the same sound."""
    if min(len(a), len(b)) == 1:
        return 0.9 * (a[0] == b[0])
    if a == b:
        return 1.0
    key = key_of(a)
    heard = 0.95 if len(key) > 1 and key == key_of(b) else 0.0
    return max(heard, jaro_winkler(a, b))


def name_similarity(a: Sequence[str], b: Sequence[str]) -> float:
    """Mean similarity of greedily paired tokens; one poor pair caps it at 0.6.

    Tokens of the shorter name (of the first, if both are as long) choose partners, initials
    last; a tie goes to the partner that comes first.
    """
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return 0.0
    open_, picked = list(many), []
    for token in [t for t in few if len(t) > 1] + [t for t in few if len(t) == 1]:
        scores = [token_similarity(token, other) for other in open_]
        best = max(scores, default=0.0)
        picked.append(best)
        if best > 0:
            del open_[scores.index(best)]
    mean = sum(picked) / len(picked)
    return min(mean, 0.6) if min(picked) < 0.75 else mean


#: Token pairs compared at a time, and the longest token whose letters fit a mask.
STEP, MASKED = 4096, 63


def jaro_of(tokens: Sequence[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaro similarities, and lengths of the common start up to four, of pairs of places in ``tokens``.

    All pairs of a step go letter by letter together: a letter of the first takes the first
    equal one of the second in reach that is free, as bits of a mask tell.
    """
    base, same = np.zeros(len(a)), np.zeros(len(a), np.int64)
    long = np.array([len(x) > MASKED or x.endswith("\0") for x in tokens], bool)
    odd = long[a] | long[b] if len(tokens) else np.zeros(0, bool)
    for k in np.flatnonzero(odd):
        x, y = tokens[a[k]], tokens[b[k]]
        base[k], same[k] = jaro(x, y), next((i for i in range(4) if x[i : i + 1] != y[i : i + 1] or i >= len(x)), 4)
    width = max([1, *(len(x) for x, far in zip(tokens, long) if not far)])
    codes = np.array([x if not far else "" for x, far in zip(tokens, long)], f"U{width}").view(np.uint32).reshape(-1, width)
    lengths = np.array([len(x) for x in tokens], np.int64)
    place = np.arange(width)
    bit = np.uint64(1) << place.astype(np.uint64)
    plain = np.flatnonzero(~odd)
    for at in range(0, len(plain), STEP):
        some = plain[at : at + STEP]
        x, y, lx, ly = codes[a[some]], codes[b[some]], lengths[a[some]], lengths[b[some]]
        reach = np.maximum(0, np.maximum(lx, ly) // 2 - 1)
        equal = (x[:, :, None] == y[:, None, :]) & (np.abs(place[:, None] - place) <= reach[:, None, None])
        equal &= (place < lx[:, None])[:, :, None] & (place < ly[:, None])[:, None, :]
        masks = np.where(equal, bit, np.uint64(0)).sum(2, dtype=np.uint64)
        taken, from_x = np.zeros(len(some), np.uint64), np.zeros(x.shape, bool)
        for i in range(width):
            free = masks[:, i] & ~taken
            first = free & (~free + np.uint64(1))
            taken |= first
            from_x[:, i] = first != 0
        from_y = (taken[:, None] & bit) != 0
        m = from_x.sum(1)
        in_x, in_y = (np.take_along_axis(c, np.argsort(~f, axis=1, kind="stable"), 1) for c, f in ((x, from_x), (y, from_y)))
        half = ((in_x != in_y) & (place < m[:, None])).sum(1) / 2
        with np.errstate(all="ignore"):
            value = (m / lx + m / ly + (m - half) / m) / 3
        whole = (lx == ly) & (x == y).all(1)
        base[some] = np.where(whole, 1.0, np.where(m > 0, value, 0.0))
        start = (x == y) & (place < lx[:, None]) & (place < ly[:, None]) & (place < 4)
        same[some] = np.cumprod(start, axis=1).sum(1)
    return base, same


def winkler(base: np.ndarray, same: np.ndarray, boost: float = 0.1) -> np.ndarray:
    return base + same * boost * (1 - base)


def _places(tokens: list[str], known: dict[str, int]) -> list[int]:
    return [known.setdefault(x, len(known)) for x in tokens]


def name_similarities(pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> np.ndarray:
    """:func:`name_similarity` of many pairs of names, all at once."""
    out = np.zeros(len(pairs))
    known: dict[str, int] = {}
    few, many, rows = [], [], []
    for k, (a, b) in enumerate(pairs):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if len(a):
            rows.append(k)
            few.append(_places([t for t in a if len(t) > 1] + [t for t in a if len(t) == 1], known))
            many.append(_places(list(b), known))
    if not rows:
        return out
    tokens = list(known)
    nf, nm = np.array([len(f) for f in few]), np.array([len(g) for g in many])
    row = np.repeat(np.arange(len(rows)), nf * nm)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(nf * nm) - nf * nm, nf * nm)
    i, j = inside // nm[row], inside % nm[row]
    # every token of the shorter name with every one of the longer
    flat = lambda lists: np.fromiter(itertools.chain.from_iterable(lists), np.int64)
    first, second = flat(few)[(np.cumsum(nf) - nf)[row] + i], flat(many)[(np.cumsum(nm) - nm)[row] + j]
    met, back = np.unique(first * len(tokens) + second, return_inverse=True)
    a, b = met // len(tokens), met % len(tokens)
    short = np.array([len(x) for x in tokens]) == 1
    keys = [key_of(x) for x in tokens]
    sounds = {s: i for i, s in enumerate(dict.fromkeys(keys))}
    sound = np.array([sounds[s] if len(s) > 1 else -1 for s in keys])
    heard = np.where((sound[a] == sound[b]) & (sound[a] >= 0), 0.95, 0.0)
    begins = np.unique([x[:1] for x in tokens], return_inverse=True)[1]
    base, same = jaro_of(tokens, a, b)
    sims = np.where(short[a] | short[b], 0.9 * (begins[a] == begins[b]), np.where(a == b, 1.0, np.maximum(heard, winkler(base, same))))[back]
    grid = np.full((len(rows), int(nf.max()), int(nm.max())), -1.0)
    grid[row, i, j] = sims
    # partners are chosen one token after the other; sums are compensated as the built-in sum is
    total, lost, least = np.zeros(len(rows)), np.zeros(len(rows)), np.full(len(rows), np.inf)
    every = np.arange(len(rows))
    for turn_of in range(grid.shape[1]):
        turn = turn_of < nf
        at = grid[:, turn_of].argmax(1)
        best = np.maximum(grid[every, turn_of, at], 0.0)
        gone = turn & (best > 0)
        grid[every[gone], :, at[gone]] = -1.0
        best = np.where(turn, best, 0.0)
        sum_ = total + best
        lost += np.where(np.abs(total) >= np.abs(best), (total - sum_) + best, (best - sum_) + total)
        total = sum_
        least = np.where(turn, np.minimum(least, best), least)
    mean = (total + lost) / nf
    out[rows] = np.where(least < 0.75, np.minimum(mean, 0.6), mean)
    return out


def _token_pairs(a: pd.Series, b: pd.Series, value) -> pd.Series:
    out, there = np.full(len(a), np.nan), np.flatnonzero(a.notna() & b.notna())
    known: dict[str, int] = {}
    x, y = (np.array(_places(c.iloc[there].tolist(), known), np.int64) for c in (a, b))
    out[there] = value(*jaro_of(list(known), x, y))
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")


@F.pandas_udf(DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _token_pairs(a, b, lambda base, same: base)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _token_pairs(a, b, winkler)


@F.pandas_udf(DoubleType())
def name_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(() if x is None else tuple(x), () if y is None else tuple(y)) for x, y in zip(a, b)]
    found = dict.fromkeys(pairs)
    return pd.Series(map(dict(zip(found, name_similarities(list(found)))).__getitem__, pairs), dtype="float64")


@F.pandas_udf(DoubleType())
def spoken_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`name_similarity` of tokens with a space between them; only different pairs are taken apart."""
    pairs = list(zip(a, b))
    found = list(dict.fromkeys(pairs))
    known = dict(zip(found, name_similarities([(x.split(), y.split()) for x, y in found])))
    return pd.Series(map(known.__getitem__, pairs), dtype="float64")
