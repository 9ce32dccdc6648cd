"""Minimal acyclic automata of word lists, whose words are numbered in order.

Built by levels with numpy: a trie of the sorted words, then states of equal height that
accept the same endings are one. An edge knows how many words lie before it, so the sum
along a word's path is the word's place in the list (a minimal perfect hash).
"""

from __future__ import annotations

import numpy as np

from kinweave.llm.bytetok import mix

_ODD = np.uint64(0x9E3779B97F4A7C15)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and where each word starts."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each range in turn."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - first, size)


class Automaton:
    """The words of a sorted list without repeats."""

    def __init__(self, words: list[str]) -> None:
        codes, starts = spelled(words)
        self.letters, codes = np.unique(codes, return_inverse=True)
        parent, letter, level, ends = self._trie(codes, starts)
        self._minimal(parent, letter, level, ends)

    @staticmethod
    def _trie(codes, starts):
        """Edges (parent, letter) whose child is the edge's place plus one, by levels; and where words end."""
        lengths = np.diff(starts)
        node, active, n = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths > 0), 1
        parents, letters, level = [], [], [0, 1]
        for depth in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            above, at = node[active], codes[starts[active] + depth]
            fresh = np.ones(len(active), bool)
            fresh[1:] = (above[1:] != above[:-1]) | (at[1:] != at[:-1])
            parents.append(above[fresh])
            letters.append(at[fresh])
            node[active] = n - 1 + np.cumsum(fresh)
            n += int(fresh.sum())
            level.append(n)
        ends = np.zeros(n, bool)
        ends[node] = len(lengths) > 0
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *parents]), np.concatenate([empty, *letters]), level, ends

    def _minimal(self, parent, letter, level, ends) -> None:
        n = len(ends)
        below, height = ends.astype(np.int64), np.zeros(n, np.int64)
        for low, high in zip(level[-2:0:-1], level[:0:-1]):  # children before parents
            np.add.at(below, parent[low - 1 : high - 1], below[low:high])
            np.maximum.at(height, parent[low - 1 : high - 1], height[low:high] + 1)
        first = np.searchsorted(parent, np.arange(n + 1))
        kind = np.zeros(n, np.int64)
        kept, states = [], 0
        order = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[order], np.arange(int(height.max()) + 2))
        for low, high in zip(cuts[:-1], cuts[1:]):
            nodes = order[low:high]
            size = first[nodes + 1] - first[nodes]
            edges = _ranges(first[nodes], size)
            sign = ends[nodes].astype(np.uint64)
            told = mix(mix((letter[edges] + 1).astype(np.uint64) * _ODD) + kind[edges + 1].astype(np.uint64))
            np.add.at(sign, np.repeat(np.arange(len(nodes)), size), told)
            _, model, same = np.unique(sign, return_index=True, return_inverse=True)
            chosen = nodes[model][same]
            alike = first[chosen + 1] - first[chosen] == size
            twins = _ranges(first[chosen], size) if alike.all() else edges
            if not (alike.all() and (ends[chosen] == ends[nodes]).all() and (letter[twins] == letter[edges]).all() and (kind[twins + 1] == kind[edges + 1]).all()):
                raise RuntimeError("two states have one sign")
            kind[nodes] = states + same
            kept.append(nodes[model])
            states += len(model)
        kept = np.concatenate(kept)
        size = first[kept + 1] - first[kept]
        edges = _ranges(first[kept], size)
        self.root, self.accepts = int(kind[0]), ends[kept]
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.letter, self.to = letter[edges], kind[edges + 1]
        words = below[edges + 1]
        before = np.cumsum(words) - words
        base = np.concatenate((before, [words.sum()]))[self.first[:-1]]
        self.before = before - np.repeat(base, size) + np.repeat(self.accepts, size)
        self.key = np.repeat(np.arange(states), size) * (len(self.letters) + 1) + self.letter

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in this automaton's letters; others than these are a letter that no edge has."""
        codes, starts = spelled(words)
        place = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        known = self.letters[place] == codes if len(self.letters) else np.zeros(len(codes), bool)
        return np.where(known, place, len(self.letters)), starts

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alive, next state, words before) for states and letters; the latter two of those alive."""
        if not len(self.key):
            return np.zeros(len(state), bool), state[:0], state[:0]
        asked = state * (len(self.letters) + 1) + letter
        edge = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        alive = self.key[edge] == asked
        return alive, self.to[edge[alive]], self.before[edge[alive]]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of word, number) of the automaton's words that are one edit from a word.

        Of word i the first ``exact[i]`` letters are matched as they are. Each pair comes once:
        of edits with one result only the last place is tried.
        """
        codes, starts = self.coded(words)
        length = np.diff(starts)
        word = np.arange(len(words))
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        pools = []  # (word, state, number, place from which the rest must match)
        for place in range(int(length.max(initial=-1)) + 1):
            trying = place >= exact[word]
            at_end = place == length[word]
            letter = np.full(len(word), -1)
            letter[~at_end] = codes[starts[word[~at_end]] + place]
            some = np.flatnonzero(trying & ~at_end)
            following = codes[np.minimum(starts[word[some]] + place + 1, max(len(codes) - 1, 0))]
            last = (place + 1 >= length[word[some]]) | (following != letter[some])
            gone = some[last]
            pools.append((word[gone], state[gone], number[gone], np.full(len(gone), place + 1)))
            some = np.flatnonzero(trying)
            size = self.first[state[some] + 1] - self.first[state[some]]
            edge, of = _ranges(self.first[state[some]], size), np.repeat(some, size)
            other = self.letter[edge] != letter[of]
            edge, of = edge[other], of[other]
            inserted = (word[of], self.to[edge], number[of] + self.before[edge])
            pools.append((*inserted, np.full(len(of), place)))
            swap = ~at_end[of]
            pools.append((*(c[swap] for c in inserted), np.full(int(swap.sum()), place + 1)))
            word, state, number, letter = (c[~at_end] for c in (word, state, number, letter))
            alive, state, before = self.step(state, letter)
            word, number = word[alive], number[alive] + before
            if not len(word):
                break
        return self._completed(codes, starts, length, pools)

    def _completed(self, codes, starts, length, pools) -> tuple[np.ndarray, np.ndarray]:
        found = []
        word, state, number, place = (np.concatenate(c) for c in zip(*pools)) if pools else [np.empty(0, np.int64)] * 4
        while len(word):
            done = place == length[word]
            good = done & self.accepts[state]
            found.append((word[good], number[good]))
            word, state, number, place = (c[~done] for c in (word, state, number, place))
            alive, state, before = self.step(state, codes[starts[word] + place])
            word, number, place = word[alive], number[alive] + before, place[alive] + 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))
