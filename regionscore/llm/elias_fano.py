"""Elias-Fano sequences and an n-gram trie of them, with vectorised lookups.

A monotone sequence of n values is kept as packed low bits and, for the high
bits, a bit vector with a one at (high part + index) for each value. Values with
one high part lie between two zeros, so that a successor search is two selects
and a binary search on low bits.
"""

from __future__ import annotations

import os

import numpy as np

#: By byte and r, the place of its r-th one (from 0; 8: it has fewer).
SELECT = np.stack([np.where((np.cumsum(b := np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1)
                             == r + 1) & (b == 1), np.arange(8), 8).min(axis=1) for r in range(8)], axis=1).astype(np.uint64)
#: Every byte of a word 01, 80, 0F; every two bits 01; every four bits 0011.
EACH, HIGH, LOW = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x0F0F0F0F0F0F0F0F)
PAIRS, FOURS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)


def select_in_words(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) in each 64-bit word; any number if it has fewer."""
    u, r = np.uint64, r.astype(np.uint64) & np.uint64(63)
    s = words - (words >> u(1) & PAIRS)
    s = (s & FOURS) + (s >> u(2) & FOURS)
    s = (s + (s >> u(4)) & LOW) * EACH  # each byte: the ones up to it
    octet = np.minimum(np.bitwise_count(((r * EACH | HIGH) - s) & HIGH), 7).astype(np.uint64) << u(3)  # bytes that end before it
    before = (s << u(8)) >> octet & u(255)
    own = words >> octet & u(255)
    return (octet + SELECT[own.astype(np.intp), np.minimum(r - before, u(7)).astype(np.intp)]).astype(np.int64)


class EliasFano:
    """arrays: low (64-bit words), high (64-bit words), zeros (zeros before each word of high); n, width, bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, n: int, width: int):
        self.low, self.high, self.zeros, self.n, self.width = low, high, zeros, n, width

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, int(top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            part = values & np.uint64((1 << width) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = ((int(ones[-1]) if n else 0) + 2 + 63) // 64 * 64
        bits = np.zeros(size, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))))
        return EliasFano(low, high, zeros, n, width)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        left = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | left) & np.uint64((1 << self.width) - 1)

    def _begin(self, h: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is at least h: ones before the zero number h-1."""
        z = h.astype(np.int64) - 1
        word = np.clip(np.searchsorted(self.zeros, z, "right") - 1, 0, len(self.high) - 1)
        found = word * 64 + select_in_words(~self.high[word], z - self.zeros[word]) - z
        return np.where(z < 0, 0, np.where(z >= self.zeros[-1], self.n, np.minimum(found, self.n)))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the index of the first value that is at least x (n: none), and whether it is x."""
        x = x.astype(np.uint64)
        h, want = x >> np.uint64(self.width), x & np.uint64((1 << self.width) - 1)
        at = self._begin(h)
        hit, open_, h = np.zeros(len(x), bool), np.arange(len(x)), h.astype(np.int64)
        for _ in range(2):  # along the ones of the high part, of which there mostly are one or two
            bit = at[open_] + h[open_]
            word = np.minimum(bit >> 6, len(self.high) - 1)
            inside = (self.high[word] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1) & (bit >> 6 < len(self.high))
            open_ = open_[inside]
            low, aim = self._low(at[open_]), want[open_]
            hit[open_[low == aim]] = True
            open_ = open_[low < aim]
            at[open_] += 1
        if len(open_):  # long runs: a binary search up to the next high part
            a, aim = at[open_], want[open_]
            end = self._begin((h[open_] + 1).astype(np.uint64))
            b = end.copy()
            live = np.flatnonzero(a < b)
            while len(live):
                mid = (a[live] + b[live]) >> 1
                less = self._low(mid) < aim[live]
                a[live[less]], b[live[~less]] = mid[less] + 1, mid[~less]
                live = live[a[live] < b[live]]
            at[open_] = a
            inside = np.flatnonzero(a < end)
            hit[open_[inside[self._low(a[inside]) == aim[inside]]]] = True
        return at, hit

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros, "shape": np.array([self.n, self.width])}

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        i = i.astype(np.int64)
        ones = np.arange(len(self.zeros)) * 64 - self.zeros  # ones before each word of high
        word = np.clip(np.searchsorted(ones, i, "right") - 1, 0, len(self.high) - 1)
        part = word * 64 + select_in_words(self.high[word], i - ones[word]) - i
        return part.astype(np.uint64) << np.uint64(self.width) | self._low(i)


class NgramTrie:
    """n-grams by levels. Level 1 holds the first ids; below, the ids that follow a path are relative to their
    context: a level's sequence is the id plus a base that grows with the context, so that it is monotone. Pointers
    say where a path's successors begin. ``codes`` of a level: quantised values, a row each.
    """

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], codes: list[np.ndarray], span: int):
        self.levels, self.pointers, self.codes, self.span = levels, pointers, codes, span

    @staticmethod
    def build(paths: np.ndarray, codes: list[np.ndarray]) -> NgramTrie:
        """paths: sorted distinct rows of ids (0: the path has ended); codes: for each level from the second, rows by its paths."""
        span = int(paths.max()) + 1 if paths.size else 1
        levels, pointers, parent = [], [], None
        for k in range(paths.shape[1]):
            fresh = prefix_starts(paths, k + 1)
            ids = paths[fresh, k].astype(np.uint64)
            if k == 0:
                levels.append(EliasFano.build(ids))
            else:
                number = (np.cumsum(parent) - 1)[fresh]  # of the context
                levels.append(EliasFano.build(number.astype(np.uint64) * np.uint64(span) + ids))
                begin = np.searchsorted(number, np.arange(int(parent.sum()) + 1))
                pointers.append(EliasFano.build(begin))
            parent = fresh
        return NgramTrie(levels, pointers, codes, span)

    def saved(self, folder: str) -> NgramTrie:
        """The same trie, its arrays memory-mapped from files in ``folder``."""
        def through(name: str, x: np.ndarray) -> np.ndarray:
            path = os.path.join(folder, name + ".npy")
            np.save(path, x)
            return np.load(path, mmap_mode="r") if x.size else x

        def sequence(name: str, s: EliasFano) -> EliasFano:
            return EliasFano(*[through(f"{name}-{k}", v) for k, v in list(s.arrays().items())[:3]], s.n, s.width)
        return NgramTrie([sequence(f"level{k}", s) for k, s in enumerate(self.levels)],
                         [sequence(f"pointer{k}", s) for k, s in enumerate(self.pointers)],
                         [through(f"codes{k}", c) for k, c in enumerate(self.codes)], self.span)

    def lookup(self, paths: np.ndarray) -> list[np.ndarray]:
        """For each level from the second, the code rows of the paths' prefixes; zeros where there is none.

        Neighbours with one prefix are looked up once: sorted paths save most of the work.
        """
        fresh = prefix_starts(paths, 1)
        group = np.cumsum(fresh) - 1
        index, hit = self.levels[0].successor(paths[fresh, 0])
        out = []
        for k in range(1, paths.shape[1]):
            begin, end = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            begin[hit] = self.pointers[k - 1].get(index[hit])
            end[hit] = self.pointers[k - 1].get(index[hit] + 1)
            at = np.flatnonzero(prefix_starts(paths, k + 1))
            parent, ids = group[at], paths[at, k]
            asked = np.flatnonzero(hit[parent] & (ids > 0) & (ids < self.span))
            context = parent[asked]
            where, same = self.levels[k].successor(index[context].astype(np.uint64) * np.uint64(self.span) + ids[asked].astype(np.uint64))
            same &= (where >= begin[context]) & (where < end[context])
            rows = np.zeros((len(at), self.codes[k - 1].shape[1]), self.codes[k - 1].dtype)
            rows[asked[same]] = self.codes[k - 1][where[same]]
            mark = np.zeros(len(paths), np.int64)
            mark[at] = 1
            group = np.cumsum(mark) - 1
            out.append(rows[group])
            index, hit = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            index[asked], hit[asked] = where, same
        return out


def prefix_starts(paths: np.ndarray, k: int) -> np.ndarray:
    """Whether each of the sorted rows begins a new prefix of length k."""
    fresh = np.ones(len(paths), bool)
    if len(paths):
        fresh[1:] = paths[1:, 0] != paths[:-1, 0]
        for j in range(1, k):
            fresh[1:] |= paths[1:, j] != paths[:-1, j]
    return fresh


def path_order(paths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order of the rows, of which first ranks the first ids: one sort of packed ids where they fit into 64 bits, else one
    a column."""
    bits = [int(c.max(initial=0)).bit_length() for c in (first, *paths.T[1:])]
    if sum(bits) > 63:
        return np.lexsort(paths.T[::-1])
    key = first.astype(np.int64)
    for j, b in enumerate(bits[1:], 1):
        key = (key << b) | paths[:, j]
    return np.argsort(key)
