"""An FM-index over a sequence of small whole numbers, searched for many patterns at a time.

The suffix array is built by prefix doubling that sorts only suffixes not yet told
apart.  The Burrows-Wheeler transform is held in a wavelet matrix: one bit vector
for each bit of a symbol, with counts by 64 bits.  Suffix positions are kept for
every SAMPLE-th place of the text; others are found by walking back from them.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        self.depth = depth
        for shift in range(depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((Bits(bits.astype(np.uint8)), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        starts = np.flatnonzero(np.diff(symbols, prepend=-1))
        self.start = np.full(1 << depth, -1, np.int64)  # where the last level has a symbol's run
        self.start[symbols[starts]] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at - self.start[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            bit, ones = bits.get(at).astype(np.int64), bits.ones(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes; the end of the text comes before any symbol."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    heads = np.concatenate(([True], sorted_text[1:] != sorted_text[:-1])) if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)  # the place of the first suffix of the same bucket, plus one; 0 past the end
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) + 1
    tied = np.flatnonzero(~heads | ~np.append(heads[1:], True)) if n else np.zeros(0, int)
    step = 1
    while len(tied):
        suffixes = order[tied]
        later = rank[np.minimum(suffixes + step, n)]
        resorted = np.lexsort((later, rank[suffixes]))
        suffixes, later = suffixes[resorted], later[resorted]
        bucket = rank[suffixes]
        order[tied] = suffixes
        first = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])))
        rank[suffixes] = np.maximum.accumulate(np.where(first, tied, 0)) + 1
        tied = tied[~first | ~np.append(first[1:], True)]
        step *= 2
    return order


class FMIndex:
    """Of a text of symbols from 1; symbol 0 is added as its end."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text)
        self.length = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))  # symbols smaller than each
        self.tree = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled.astype(np.uint8)), order[sampled]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern (its symbols in the first `lengths` columns): from, to."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.length, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            present = self.before[symbol + 1] > self.before[symbol]
            high[live[~present]] = low[live[~present]]
            live, symbol = live[present], symbol[present]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text where the suffix of each row begins."""
        out, walked, at = np.zeros(len(rows), np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.sampled.get(at) == 1
            out[open_[found]] = self.samples[self.sampled.ones(at[found])] + walked
            open_, at = open_[~found], at[~found]
            symbol, rank = self.tree.symbol_and_rank(at)
            at, walked = self.before[symbol] + rank, walked + 1
        return out
