"""FM-index over a sequence of small numbers: suffix array, Burrows-Wheeler transform, wavelet tree.

Symbol 0 separates stretches and is never searched.  All steps work on whole arrays: a search takes
all patterns at once, one symbol of every pattern per round.
"""

from __future__ import annotations

import numpy as np

# Every `RATE`-th position of the sequence keeps its place in the index.
RATE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order.  The sequence ends with a 0; separators are
    ordered by position, so no comparison goes beyond one.

    Prefix doubling from as many symbols as one number holds; a round sorts only what the rounds
    before left equal.
    """
    n = len(symbols)
    parting = symbols == 0
    first = np.where(parting, np.cumsum(parting) - 1, symbols + np.int64(parting.sum()))
    bits = max(1, int(first.max()).bit_length())
    depth = max(1, 63 // bits)
    keys = first.copy()
    for ahead in range(1, depth):
        keys <<= bits
        if ahead < n:
            keys[:-ahead] |= first[ahead:]
    suffixes = np.argsort(keys)
    rank = np.empty(n, np.int64)
    at, placed = np.arange(n), keys[suffixes]
    while True:
        # `at` are the places still sorted, `placed` their keys in order: equal keys share a rank
        heads = np.concatenate([[True], placed[1:] != placed[:-1]])
        rank[suffixes[at]] = at[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]
        alone = heads & np.concatenate([heads[1:], [True]])
        at = at[~alone]
        if not len(at):
            return suffixes
        members = suffixes[at]
        keys = rank[members] << 32 | rank[members + depth]
        order = np.argsort(keys)
        suffixes[at], placed = members[order], keys[order]
        depth *= 2


class WaveletTree:
    """Ranks of symbols: a bit vector per level, symbols of a level sorted by their upper bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        width = 1 << self.levels
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=width))])
        self.ones, self.begin, self.before = [], [], []
        names = np.arange(width)
        for level in range(self.levels):
            shift = self.levels - 1 - level
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(symbols >> shift & 1, out=ones[1:])
            begin = self.first[names >> (shift + 1) << (shift + 1)]
            self.ones.append(ones)
            self.begin.append(begin)
            self.before.append(ones[begin])
            if shift:
                # the next level is sorted by one bit more
                symbols = symbols[np.argsort(symbols >> shift, kind="stable")]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position `end` of the sequence."""
        count = end
        for level in range(self.levels):
            ones = self.ones[level][self.begin[level][symbol] + count] - self.before[level][symbol]
            set_ = symbol >> (self.levels - 1 - level) & 1 == 1
            count = np.where(set_, ones, count - ones)
        return count


class FMIndex:
    """Index of a sequence with values below `size` that ends with the separator 0."""

    def __init__(self, symbols: np.ndarray, size: int, rate: int = RATE):
        suffixes = suffix_array(symbols)
        self.last = symbols[suffixes - 1]
        self.tree = WaveletTree(self.last, size)
        self.first = self.tree.first
        # Sampled: every `rate`-th position, and those behind a separator, where a walk ends.
        sampled = (suffixes % rate == 0) | (self.last == 0)
        self.sampled = sampled
        self.sample = np.cumsum(sampled) - 1
        self.position = suffixes[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [begin, end) of the suffixes that start with each pattern.  Patterns are rows of a
        matrix, aligned to the right and padded with -1 on the left."""
        begin = np.zeros(len(patterns), np.int64)
        end = np.full(len(patterns), len(self.last), np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            live, symbol = live[symbol >= 0], symbol[symbol >= 0]
            if not len(live):
                break
            start = self.first[symbol]
            begin[live] = start + self.tree.rank(symbol, begin[live])
            end[live] = start + self.tree.rank(symbol, end[live])
            live = live[begin[live] < end[live]]
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the index: each walks back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            found = self.sampled[at]
            out[open_[found]] = self.position[self.sample[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            symbol = self.last[at]
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
