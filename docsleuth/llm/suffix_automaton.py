"""A generalised suffix automaton over words, and the matching statistics of texts against it.

State arrays are plain lists, so that an automaton travels to executors as one small object. Words are runs
of ASCII letters and digits, lower-cased, and of any other characters beyond ASCII.
"""

from __future__ import annotations

import numpy as np

_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences, each added by itself, so that no match crosses from one to the next."""

    def __init__(self, sequences: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: of each state, the sequences whose prefix made it; others inherit along suffix links
        self.own: list[set[int]] = [set()]
        self.ends: list[int] = []
        for k, seq in enumerate(sequences):
            last = 0
            for w in seq:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids) + 1))
                self.own[last].add(k)
            self.ends.append(last)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.own.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another sequence has come this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def by_length(self) -> list[int]:
        return sorted(range(len(self.length)), key=self.length.__getitem__)

    def occurrences(self, length: int) -> dict[int, frozenset[int]]:
        """For each state that holds the substring of exactly this length among its own: the sequences where it stands."""
        out: dict[int, set[int]] = {}
        for s, own in enumerate(self.own):
            if own and self.length[s] >= length:
                at = s
                while self.length[self.link[at]] >= length:
                    at = self.link[at]
                out.setdefault(at, set()).update(own)
        return {s: frozenset(v) for s, v in out.items()}

    def known(self, text: list[bytes]) -> np.ndarray:
        """Each word's id; 0 for words that no sequence has."""
        get = self.ids.get
        return np.fromiter([get(w, 0) for w in text], np.int64, len(text))

    def walk(self, ids: list[int]):
        """The matching statistics: for each word, the state and the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in ids:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state = to
                size += 1
            yield state, size


def runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where at least so many known words follow one another: (start, end). Nothing shorter can hold a match of that length."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
