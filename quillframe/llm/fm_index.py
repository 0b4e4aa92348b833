"""A compressed FM-index over integer texts: a wavelet matrix of the Burrows-Wheeler transform, of 16 packed bit vectors a level.

All operations take arrays of queries, so that one step of many searches is a few array operations for each level.
"""

from __future__ import annotations

import numpy as np


#: Bits of a symbol that a level of the wavelet matrix tells apart.
DIGIT = 4


class Digits:
    """Digits with, for each value, a packed bit vector of its places and the count of those before each 64-bit word."""

    def __init__(self, digits: np.ndarray):
        self.stride = len(digits) // 64 + 1  # words of a vector
        padded = np.full(64 * self.stride, 255, np.uint8)
        padded[: len(digits)] = digits
        each = [np.packbits(padded == d, bitorder="little").view("<u8").astype(np.uint64) for d in range(1 << DIGIT)]
        self.words = np.concatenate(each)
        ones = np.bitwise_count(self.words).astype(np.int64)
        # Places of the next level: those of lesser digits come first, so the counts of all vectors go on from one to the next.
        self.before = np.cumsum(ones) - ones

    def descend(self, digit: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place at the next level of place ``i``, on the way of ``digit``."""
        word = digit * self.stride + (i >> 6)
        mask = (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Digits]] = []
        for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
            digits = (symbols >> shift & (1 << DIGIT) - 1).astype(np.uint8)
            self.levels.append((shift, Digits(digits)))
            symbols = symbols[np.argsort(digits, kind="stable")]

        #: Where the run of each symbol begins at the last level: the way of place 0.
        known = np.arange(1 << bits, dtype=np.int64)
        self.begins = self._descend(known, np.zeros(len(known), np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The places ``i`` at the last level, on the way of their symbols."""
        for shift, level in self.levels:
            i = level.descend(symbol >> shift & (1 << DIGIT) - 1, i)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i; relative to where the symbol's run begins at the last level."""
        return self._descend(symbol, i) - self.begins[symbol]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by prefix doubling, to ``depth`` symbols; enough where separators tell all suffixes apart by then.

    ``text`` has numbers from 0; the first sort takes as many symbols at once as fit into 63 bits.
    """
    n, bits = len(text), int(text.max() + 1).bit_length()
    step = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] += text[k:] + 1
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if step >= depth or step >= n or rank[order[-1]] == n - 1:
            return order
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1
        key = rank * (n + 2) + following
        step *= 2


class FMIndex:
    """Index of several texts; ``texts`` hold any 64-bit values. Matches never cross from one text into another.

    ``times`` says how often each text occurs (1 where it is not given): an interval counts all occurrences.
    """

    def __init__(self, texts: list[np.ndarray], times: np.ndarray | None = None):
        lengths = np.array([len(x) for x in texts])
        values, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        n, k = int(lengths.sum()) + len(texts), len(texts)
        # Every text ends in a separator of its own, below all symbols, so no two suffixes are equal.
        whole = np.full(n, -1, np.int64)
        ends = self.starts + lengths
        whole[ends] = np.arange(k)
        whole[whole < 0] = inverse + k
        order = suffix_array(whole, int(lengths.max()) + 2)
        #: Symbols as the index knows them: 0 for separators, else from 1 in order of the values.
        self.symbols = np.maximum(whole - k + 1, 0)
        self.size = n
        counts = np.bincount(self.symbols, minlength=len(values) + 1)
        self.first = np.r_[0, np.cumsum(counts)]
        each = np.ones(k, np.int64) if times is None else np.asarray(times, np.int64)
        #: Occurrences of the suffixes before each place of their order.
        self.weights = np.r_[0, np.cumsum(np.repeat(each, lengths + 1)[order])]
        #: The symbol before each suffix, in their order.
        self.transform = self.symbols[order - 1]
        self.matrix = WaveletMatrix(self.transform, max(1, int(len(values)).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with ``symbol`` put before them."""
        many = np.flatnonzero(high - low > 1)
        begin = self.first[symbol]
        below = begin + self.matrix.rank(symbol, low)
        above = below + ((self.transform[np.minimum(low, self.size - 1)] == symbol) & (low < high))  # for one suffix at most
        above[many] = begin[many] + self.matrix.rank(symbol[many], high[many])
        return below, above

    def repeated_windows(self, which: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
        """For texts ``which`` (numbers) with so many ``windows`` of ``width`` symbols, the windows that occur twice or more in
        the index, as bit masks.

        Matching statistics by backward search: from a right end, a match grows to the left for as long as it occurs
        elsewhere. Where it reaches the width, all windows within it repeat; where it ends before, no window that holds
        the failing stretch can repeat. Searches from the right end and from the left window take turns, each
        narrowing the windows that are left; all texts advance together.
        """
        masks = np.zeros(len(which), np.uint64)
        first, last = np.zeros(len(which), np.int64), windows.astype(np.int64) - 1
        base, live, right = self.starts[which], np.arange(len(which)), np.ones(len(which), bool)
        at, low, high = last + width - 1, np.zeros(len(which), np.int64), np.full(len(which), self.size, np.int64)
        one = np.uint64(1)

        def ones(n: np.ndarray) -> np.ndarray:
            return np.where(n >= 64, ~np.uint64(0), (one << np.minimum(n, 63).astype(np.uint64)) - one)

        while len(live):
            symbol = self.symbols[base[live] + at[live]]
            lo, hi = self.extend(symbol, low[live], high[live])
            grows = self.weights[hi] - self.weights[lo] >= 2
            low[live], high[live] = lo, hi
            moved = live[grows]
            at[moved] -= 1
            ended = np.r_[moved[at[moved] < first[moved]], live[~grows]]
            if not len(ended):
                continue
            # The match holds the positions over `at`; `at` failed, or the leftmost window's start was passed.
            p, from_right = at[ended], right[ended]
            r = ended[from_right]
            pr = at[r]
            long_enough = last[r] - pr >= 1
            hit = r[long_enough]
            masks[hit] |= ones(last[hit] + 1) & ~ones(at[hit] + 1)
            last[r] = np.where(long_enough, pr, last[r] - 1)
            l = ended[~from_right]
            pl = p[~from_right]
            whole = pl < first[l]
            masks[l[whole]] |= one << first[l[whole]].astype(np.uint64)
            first[l] = np.where(whole, first[l] + 1, pl + 1)
            right[ended] = ~from_right
            at[ended] = np.where(right[ended], last[ended], first[ended]) + width - 1
            low[ended], high[ended] = 0, self.size
            live = live[first[live] <= last[live]]
        return masks
