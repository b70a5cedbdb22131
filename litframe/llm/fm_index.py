"""A full-text index over words of one shard: suffix order, wavelet matrix, samples.

The shard is a sequence of word numbers in which every text ends with a mark of
its own. Phrases are found by backward search: each step narrows an interval of
the suffix order by two ranks in the wavelet matrix of the transformed sequence.
Positions are kept for every 16th word and for first words of texts; others are
found by walking back to one of these.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(ranks: np.ndarray, base: int) -> np.ndarray:
    """Positions in the order of their suffixes.

    ``ranks`` are below ``base``; equal suffixes must not exist, which marks that
    differ see to. Sorting by two or three symbols comes first; then only
    positions that are still tied are sorted again, by twice the length each time.
    """
    n = len(ranks)
    bits = max(int(base - 1).bit_length(), 1)
    depth = 3 if 3 * bits <= 63 else 2
    padded = np.concatenate([ranks, np.zeros(depth, np.int64)])
    key = ranks.copy()
    for k in range(1, depth):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied):
        at = order[tied]
        key = (rank[at] << 32) | rank[at + depth]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        depth *= 2
    return order


class BitRanks:
    """Bits with the number of ones before every 64th of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks of symbols, and symbols at places, by one bit array per symbol bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(int(top).bit_length(), 1)
        self.levels: list[tuple[int, BitRanks]] = []
        left = symbols
        for bit in range(self.bits - 1, -1, -1):
            ones = (left >> bit) & 1 != 0
            self.levels.append((len(ones) - int(ones.sum()), BitRanks(ones)))
            left = np.concatenate([left[~ones], left[ones]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` ends up on the symbol's way down; differences are ranks."""
        for level, (zeros, ranks) in enumerate(self.levels):
            ones = ranks.rank(at)
            one = (symbol >> (self.bits - 1 - level)) & 1 != 0
            at = np.where(one, zeros + ones, at - ones)
        return at

    def symbol_and_place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(at), np.int64)
        for zeros, ranks in self.levels:
            one = ranks.get(at)
            ones = ranks.rank(at)
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of texts given as runs of word numbers 1, 2, ... up to ``top``."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, top: int):
        texts = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        total = int(ends[-1]) + 1 if texts else 0
        sequence = np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[ends] = False
        sequence[inner] = words
        ranks = sequence + (texts - 1)
        ranks[ends] = np.arange(texts)
        self.order_length = total
        order = suffix_order(ranks, texts + top + 1)
        before = sequence[order - 1]
        before[order == 0] = 0
        self.matrix = WaveletMatrix(before, top)
        counts = np.bincount(sequence, minlength=top + 2)
        self.less = np.cumsum(counts) - counts
        symbols = np.arange(top + 1)
        self.origin = self.matrix.place(symbols, np.zeros(top + 1, np.int64))
        first = np.zeros(total, bool)
        first[0] = True
        first[ends[:-1] + 1] = True
        kept = ((order % SAMPLE) == 0) | first[order]
        self.sampled = BitRanks(kept)
        self.samples = order[kept]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.matrix.place(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases, given one per row with the last word in the last
        column; words that are not in the shard are 0."""
        n, width = phrases.shape
        low = np.zeros(n, np.int64)
        high = np.full(n, self.order_length, np.int64)
        in_use = np.arange(width) >= width - lengths[:, None]
        alive = np.flatnonzero(((phrases > 0) | ~in_use).all(1) & (lengths > 0))
        high[np.setdiff1d(np.arange(n), alive)] = 0
        for k in range(width):
            active = alive[lengths[alive] > k]
            if not len(active):
                break
            symbol = phrases[active, width - 1 - k]
            low[active] = self._step(symbol, low[active])
            high[active] = self._step(symbol, high[active])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of rows of the suffix order."""
        found = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        at, steps = rows.copy(), 0
        while len(open_):
            known = self.sampled.get(at)
            found[open_[known]] = self.samples[self.sampled.rank(at[known])] + steps
            open_, at = open_[~known], at[~known]
            if len(open_):
                symbol, place = self.matrix.symbol_and_place(at)
                at = self.less[symbol] + place - self.origin[symbol]
            steps += 1
        return found
