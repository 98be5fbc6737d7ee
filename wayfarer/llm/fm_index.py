"""A compressed full-text index over word numbers, in numpy.

The Burrows-Wheeler transform of several word sequences lies in a wavelet matrix:
one bit a word and level, packed 64 to an integer beside a count for each integer.
Backward search over it yields matching statistics of many patterns at once.
"""

from __future__ import annotations

import numpy as np

_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class _Bits:
    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones there are before each position."""
        at = i >> 6
        return self.counts[at] + np.bitwise_count(self.words[at] & _BELOW[i & 63])


class FmIndex:
    """Index of sequences of positive ints, which are given one after another.

    Matches are measured exactly up to ``depth``; longer ones count as no shorter.
    """

    def __init__(self, values: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth = depth
        n_seq, ends = len(lengths), np.cumsum(lengths)
        n = len(values) + n_seq
        self.sequence = np.repeat(np.arange(n_seq), lengths + 1)
        text = np.zeros(n, np.int64)
        stop = ends + np.arange(n_seq)
        text[np.setdiff1d(np.arange(n), stop, assume_unique=True)] = values
        self.sigma = int(values.max(initial=0)) + 1

        # Suffixes are ordered by prefix doubling; each separator is a symbol of its own.
        rank = text + n_seq
        rank[stop] = np.arange(n_seq)
        ranks, k = [], 1
        _, rank = np.unique(rank, return_inverse=True)
        while True:
            ranks.append(rank)
            if rank.max(initial=0) == n - 1:
                break
            second = np.full(n, -1, np.int64)
            second[: n - k] = rank[k:]
            key = rank * np.int64(n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            k *= 2
        self.suffix = np.empty(n, np.int64)
        self.suffix[rank] = np.arange(n)

        lcp = np.zeros(n + 1, np.int64)
        a, b = self.suffix[:-1].copy(), self.suffix[1:].copy()
        for j in range(min(len(ranks), depth.bit_length()) - 1, -1, -1):
            same = (a < n) & (b < n)
            same[same] = ranks[j][a[same]] == ranks[j][b[same]]
            lcp[1:n] += same << j
            a, b = a + (same << j), b + (same << j)
        self.lcp = lcp
        at = np.arange(n + 1)
        self.before, self.after = np.zeros(n + 1, np.int64), np.full(n + 1, n, np.int64)
        for depth in np.unique(lcp[lcp > 0]):
            less, here = lcp < depth, lcp == depth
            self.before[here] = np.maximum.accumulate(np.where(less, at, 0))[here]
            self.after[here] = np.minimum.accumulate(np.where(less, at, n)[::-1])[::-1][here]

        bwt = text[self.suffix - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels: list[tuple[_Bits, int]] = []
        for level in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.levels.append((_Bits(bit.astype(bool)), int(len(bit) - bit.sum())))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        symbols = np.arange(self.sigma)
        self.base = self._walk(symbols, np.zeros(self.sigma, np.int64))
        self.n = n

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol & (1 << (len(self.levels) - 1 - level)), zeros + ones, i - ones)
        return i

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self._walk(symbol, i) - self.base[symbol]

    def matching_statistics(self, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the patterns, the longest match that starts there.

        Returns its length and where in suffix order the matches begin. Patterns are
        read from their ends backwards, all at the same time; where one can't be
        extended it gives up words at its right end until it can.
        """
        size, where = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)[by_length]
        sorted_lengths = lengths[by_length]
        lo, hi, deep = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n), np.zeros(len(lengths), np.int64)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-sorted_lengths, -t, "left"))
            place = ends[:m] - 1 - t
            todo = np.arange(m)
            known = (values[place] > 0) & (values[place] < self.sigma)
            lo[:m][~known], hi[:m][~known], deep[:m][~known] = 0, self.n, 0
            todo = todo[known]
            while len(todo):
                c = values[place[todo]]
                both = self._step(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                a, b = both[: len(c)], both[len(c) :]
                ok = a < b
                lo[todo[ok]], hi[todo[ok]] = a[ok], b[ok]
                deep[todo[ok]] += 1
                todo = todo[~ok & (deep[todo] > 0)]
                left, right = lo[todo], hi[todo]
                depth = np.maximum(self.lcp[left], self.lcp[right])
                lo[todo] = np.where(self.lcp[left] == depth, self.before[left], left)
                hi[todo] = np.where(self.lcp[right] == depth, self.after[right], right)
                root = depth == 0
                lo[todo[root]], hi[todo[root]] = 0, self.n
                deep[todo] = depth
            size[place], where[place] = deep[:m], lo[:m]
        return size, where

    def least(self, of_sequence: np.ndarray) -> np.ndarray:
        """For each place in suffix order, the least of ``of_sequence`` over all
        suffixes that have their first ``depth`` words in common with it."""
        opens = np.flatnonzero(self.lcp[: self.n] < self.depth)
        low = np.minimum.reduceat(of_sequence[self.sequence[self.suffix]], opens)
        return np.repeat(low, np.diff(np.append(opens, self.n)))
