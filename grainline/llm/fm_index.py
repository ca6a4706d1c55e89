"""FM-index of a sequence of integers over a wavelet matrix of packed bits, with vectorised backward search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def bounded_suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols or more, by prefix doubling. With ties beyond that depth
    left open, backward search is exact for patterns of up to `depth` symbols."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth:
        second = np.zeros(n, np.int64)
        second[:max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[sa][1:] != key[sa][:-1])]) if n else rank
        rank = np.empty(n, np.int64)
        rank[sa] = new
        reach *= 2
        if n and new[-1] == n - 1:
            break
    return sa


class Bits:
    """A bit vector in 64-bit words with a rank directory of one 32-bit count a word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    def __init__(self, s: np.ndarray, depth: int):
        """s: symbols 0 .. sigma - 1; patterns of up to depth symbols can be searched."""
        self.n = len(s)
        sa = bounded_suffix_array(s, depth)
        bwt = s[sa - 1]  # of the suffix at 0 the last symbol: the text is cyclic, a separator stands there
        sigma = int(s.max()) + 1 if self.n else 1
        self.levels = max(1, (sigma - 1).bit_length())
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank1(i)
            i = np.where(symbol >> level & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        return self._down(symbol, i) - self.first[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns: one step of backward search."""
        both = self.occurrences(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.start[symbol] + both[:len(symbol)], self.start[symbol] + both[len(symbol):]

    def matching(self, s: np.ndarray, end: np.ndarray, floor: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """Matching statistics, at most `most`: for each place end, the length of the longest run of symbols
        s[end - length + 1 .. end] that starts at floor or later and has at least `least` occurrences."""
        length = np.zeros(len(end), np.int64)
        lane = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n)
        for step in range(most):
            at = end[lane] - step
            go = at >= floor[lane]
            lane, low, high, at = lane[go], low[go], high[go], at[go]
            if not len(lane):
                break
            low, high = self.extend(s[at], low, high)
            go = high - low >= least
            lane, low, high = lane[go], low[go], high[go]
            length[lane] = step + 1
        return length
