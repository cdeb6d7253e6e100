"""FM-index of a shard's words: suffix array, wavelet matrix, sampled positions.

A shard is the text of one Spark task (or a bounded part of it). Symbols are
ranks in the alphabet of the searched phrases; 0 ends a run of such words.
"""

from __future__ import annotations

import numpy as np

#: One in so many positions of the text is kept for its suffix.
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; each 0 is a sentinel of its own, the earlier the smaller."""
    n = len(symbols)
    zeros = symbols == 0
    ends = int(zeros.sum())
    rank = symbols.astype(np.int64) + ends
    rank[zeros] = np.arange(ends)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if int(rank[order[-1]]) == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.pad(packed, (0, (n // 64 + 1) * 8 - len(packed))).tobytes(), np.uint64)
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Backward search and locate over symbols 0..size-1."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]  # the text starts with a 0, so the wrap-around adds no match
        self.n, self.first = n, np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.levels, self.zeros, self.depth = [], [], max(1, int(size - 1).bit_length())
        level = bwt.astype(np.int64)
        for k in reversed(range(self.depth)):
            ones = (level >> k) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(n - int(ones.sum()))
            level = np.concatenate([level[~ones], level[ones]])
        kept = (order % SAMPLE == 0) | (bwt == 0)  # also each run's first position, so that no walk crosses a 0
        self.marked, self.samples = Bits(kept), order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i of the transformed text."""
        lo = np.zeros_like(i)
        for k, bits, zeros in zip(reversed(range(self.depth)), self.levels, self.zeros, strict=True):
            one = (symbol >> k) & 1 == 1
            a, b = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at position i and its occurrences before."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for k, bits, zeros in zip(reversed(range(self.depth)), self.levels, self.zeros, strict=True):
            one = bits.get(i)
            a, b = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
            symbol |= one.astype(np.int64) << k
        return symbol, i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each row of a matrix of phrases of one length; empty where none occurs."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.arange(len(phrases))
        a, b = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            a, b = self.first[c] + self.rank(c, a), self.first[c] + self.rank(c, b)
            some = a < b
            alive, a, b = alive[some], a[some], b[some]
            if not len(alive):
                return lo, hi
        lo[alive], hi[alive] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            found = self.marked.get(at)
            out[left[found]] = self.samples[self.marked.rank(at[found])] + steps
            left, at = left[~found], at[~found]
            if len(left):
                symbol, before = self.access(at)
                at = self.first[symbol] + before
            steps += 1
        return out
