"""An FM-index over a wavelet matrix, and matching statistics of streams by backward search.

The index of a shard is the Burrows-Wheeler transform of its segments as packed bit vectors with counts, the starts of
the intervals of suffixes that share a window, and the smallest document id of each such interval. Segments are
streamed from their right ends, many at a time: each step extends the match by one word, and once it is longer than a
window the interval is widened to all suffixes that share the window, which is the matching statistic cut at the
threshold.
"""

from __future__ import annotations

import numpy as np

from pyrewatch.llm.suffixes import common_prefixes, suffix_array


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for level in range(self.bits - 1, -1, -1):
            ones = (sequence >> level) & 1 == 1
            self.levels.append((BitVector(ones), int(len(sequence) - ones.sum())))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))
        # Where each symbol's run starts once all bits are sorted out.
        self.start = np.zeros(1 << self.bits, np.int64)
        found, first = np.unique(sequence, return_index=True)
        self.start[found] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``, elementwise."""
        at = at.copy()
        for level, (vector, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            ones = vector.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.start[symbol]


class ShardIndex:
    """Index of the concatenated segments of a shard. Symbol 0 separates them; words are 1 and up."""

    def __init__(self, text: np.ndarray, symbols: int, ids: np.ndarray, size: int):
        """``ids`` holds for each position the document id of its segment."""
        n = len(text)
        array = suffix_array(text, symbols)
        shared = common_prefixes(text, array, symbols) >= size
        self.size = size
        last = text[array - 1]
        self.tree = WaveletMatrix(last, symbols)
        counts = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        # The array holds no empty suffix, so the symbol before position 0 is the last separator.
        self.heads = np.flatnonzero(~shared)
        self.interval = (np.cumsum(~shared) - 1).astype(np.int32)
        self.ends = np.append(self.heads[1:], n)
        self.smallest = np.minimum.reduceat(ids[array], self.heads)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches lengthened by a symbol on the left."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low):]

    def statistics(self, streams: list[np.ndarray]) -> list[np.ndarray]:
        """For each stream and each start of a window in it, the smallest id of a document that holds the window.

        A window that nothing holds gets the largest id; the streams of a shard are in its index, so all are found.
        """
        order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
        lengths = np.array([len(streams[i]) for i in order], np.int64)
        ends = np.cumsum(lengths)
        flat = np.concatenate([streams[i] for i in order]) if order else np.zeros(0, np.int64)
        found = np.full(len(flat), np.iinfo(np.int64).max)
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), len(self.interval), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = ends[:live] - 1 - step
            a, b = self.extend(flat[at], low[:live], high[:live])
            if step + 1 >= self.size:
                some = b > a
                inside = self.interval[np.minimum(a, len(self.interval) - 1)]
                # Longer than a window: widen to every suffix that starts with it.
                a, b = np.where(some, self.heads[inside], a), np.where(some, self.ends[inside], b)
                found[at[some]] = self.smallest[inside[some]]
            low[:live], high[:live] = a, b
        out: list[np.ndarray] = [flat[:0]] * len(streams)
        for place, i in enumerate(order):
            start = int(ends[place] - lengths[place])
            out[i] = found[start: start + max(0, len(streams[i]) - self.size + 1)]
        return out
