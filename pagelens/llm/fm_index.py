"""A word-level FM-index: Burrows-Wheeler transform in a wavelet matrix of bit vectors with rank.

Backward search extends a match by one word to the left with two rank queries. Matches are
followed up to `cap` words: when one is longer, its interval widens to the class of suffixes
that share the first `cap` words, so that every position of a streamed text gets its matching
statistic min(longest match, cap) and, at the cap, the interval of all occurrences.
All streamed texts advance together, one numpy step a word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with rank in constant time: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1)))


class FMIndex:
    """Over `text`, numbers from 0 where 0 separates entries; `owner` is a number of each position."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, cap: int):
        self.cap, n = cap, len(text)
        part = 1 << (cap.bit_length() - 1)
        rank, k, at_part, sa = text.astype(np.int64), 1, None, None
        while True:
            if k == part:
                at_part = np.unique(rank, return_inverse=True)[1] if k == 1 else rank.copy()
            second = np.zeros(n, np.int64)
            second[: max(n - k, 0)] = rank[k:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + second
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            k *= 2
            if k >= cap:
                break
        if at_part is None:
            at_part = rank.copy()
        # the class of a suffix: its first `cap` words, as two overlapping runs of `part` words
        second = np.full(n, -1, np.int64)
        second[: max(n - (cap - part), 0)] = at_part[cap - part :]
        a, b = at_part[sa], second[sa]
        begins = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        self.starts = np.flatnonzero(begins)
        self.class_of = (np.cumsum(begins) - 1).astype(np.int32)
        self.ends = np.append(self.starts[1:], n)
        self.least = np.minimum.reduceat(owner[sa], self.starts)
        bwt = text[sa - 1]
        self.symbols = int(text.max(initial=0)) + 1
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=self.symbols)))
        self.levels: list[Bits] = []
        for shift in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.n = n
        self.base = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.rank(i)
            up = ((symbol >> (len(self.levels) - 1 - level)) & 1).astype(bool)
            i = np.where(up, bits.zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + match; empty where it doesn't occur."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def find(self, pattern: np.ndarray) -> tuple[int, int]:
        """The interval of one pattern of at most `cap` known symbols."""
        low, high = np.zeros(1, np.int64), np.full(1, self.n)
        for c in pattern[::-1]:
            low, high = self.extend(np.array([c]), low, high)
            if low[0] >= high[0]:
                break
        return int(low[0]), int(high[0])

    def matching_statistics(self, streams: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the streams (known symbols from 1; 0 for words that the index hasn't): the longest
        match that begins there, at most `cap`, and where it is `cap` the smallest owner of its occurrences, else -1.
        Stream i is streams[start[i] : start[i] + length[i]]."""
        matched, owner = np.zeros(len(streams), np.int32), np.full(len(streams), -1, np.int64)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        low, high, depth = np.zeros(len(start), np.int64), np.full(len(start), self.n), np.zeros(len(start), np.int32)
        for s in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -s, "left"))  # streams longer than s
            at = start[:m] + length[:m] - 1 - s
            c = streams[at]
            lo, hi = self.extend(c, low[:m], high[:m])
            d = depth[:m] + 1
            for i in np.flatnonzero((lo >= hi) | (c == 0)):  # the match breaks: the longest shorter one is looked up
                a, most = int(at[i]), int(d[i]) - 1
                good, best = 0, (0, self.n)
                if c[i]:
                    while good < most:
                        half = (good + most + 1) // 2
                        x = self.find(streams[a : a + half])
                        if x[0] < x[1]:
                            good, best = half, x
                        else:
                            most = half - 1
                lo[i], hi[i], d[i] = *best, good
            full = np.flatnonzero(d >= self.cap)
            k = self.class_of[lo[full]]
            lo[full], hi[full], d[full] = self.starts[k], self.ends[k], self.cap
            matched[at], owner[at[full]] = d, self.least[k]
            low[:m], high[:m], depth[:m] = lo, hi, d
        return matched, owner
