"""A compact FM-index over word sequences with bounded context.

Suffixes are sorted by their first ``depth`` words only. For patterns of up to that
length backward search over such a transform is exact, as rows that agree on ``depth``
words belong to the same interval in any order. The transform is kept as a wavelet
tree, level by level: one packed bit vector and its rank counts per bit of the symbols.
"""

from __future__ import annotations

import numpy as np

_SEPARATOR = 0


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        room[:len(packed)] = packed
        self.words = room.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks of any symbol in a sequence of integers, in one rank per bit of a symbol."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
            self.zeros.append(int(len(bit) - bit.sum()))
        first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
        self.base = np.zeros(n_symbols, np.int64)
        self.base[sequence[first]] = first

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for k, (vector, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = vector.rank(at)
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at - self.base[symbols]


class FMIndex:
    """Index over several word sequences, each with an integer owner.

    ``values`` are word hashes of all sequences end to end, ``sizes`` their lengths.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int):
        self.depth = depth
        self.alphabet, ids = np.unique(values, return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(len(values) + len(sizes), np.int64)
        own = np.ones(len(text), bool)
        own[ends] = False
        text[own] = ids + 1
        ranks = [text]
        width = 1
        while 2 * width <= depth:
            ranks.append(np.unique(self._pairs(ranks[-1], width), return_inverse=True)[1].astype(np.int64))
            width *= 2
        rows = np.argsort(self._pairs(ranks[-1], depth - width) if depth > width else ranks[-1], kind="stable")
        # Common prefix of neighbouring rows, up to ``depth`` words.
        common = np.zeros(len(text), np.int64)
        for r in reversed(ranks):
            size = 1 << next(i for i, x in enumerate(ranks) if x is r)
            padded = np.concatenate((r, np.full(2 * depth, -1)))
            same = padded[rows[1:] + common[1:]] == padded[rows[:-1] + common[1:]]
            common[1:] += size * same
        self.common = np.minimum(common, depth).astype(np.int16)
        self.n = len(text)
        symbols = len(self.alphabet) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.tree = WaveletTree(text[rows - 1], symbols)
        start = np.flatnonzero(self.common < depth)
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least = np.minimum.reduceat(np.repeat(owners, sizes + 1)[rows], start)
        self.least_owner = np.repeat(least, np.diff(np.append(start, self.n)))

    @staticmethod
    def _pairs(rank: np.ndarray, shift: int) -> np.ndarray:
        later = np.concatenate((rank[shift:], np.zeros(min(shift, len(rank)), np.int64)))
        return rank * (int(rank.max(initial=0)) + 1) + later

    def block(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row: the interval of rows that share its first ``depth`` words."""
        if depth not in self._blocks:
            start = np.flatnonzero(self.common < depth) if depth else np.zeros(1, np.int64)
            size = np.diff(np.append(start, self.n))
            self._blocks[depth] = np.repeat(start, size), np.repeat(start + size, size)
        return self._blocks[depth]

    def step(self, lo: np.ndarray, hi: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one more word in front."""
        both = self.tree.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        base = self.first[symbols]
        return base + both[:len(lo)], base + both[len(lo):]

    def symbols(self, values: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 for words that the index does not have."""
        at = np.searchsorted(self.alphabet, values)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == values, at + 1, _SEPARATOR) if len(self.alphabet) else np.zeros(len(values), np.int64)

    def matching_statistics(self, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the streamed sequences: length of the longest match that starts
        there, up to ``depth``, and a row of its interval.

        All sequences move one word to the left per step. A match of full depth is first
        shortened at its right end (the parent interval), as is one that can't be extended.
        """
        n = len(values)
        length, row = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pattern = self.symbols(values)
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[order]
        by_size = sizes[order]
        lo, hi, have = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64), np.zeros(len(sizes), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            active = int(np.searchsorted(-by_size, -t, side="right"))
            at = ends[:active] - t
            symbols = pattern[at]
            a, b, k = lo[:active].copy(), hi[:active].copy(), have[:active].copy()
            a, b, k = self._shorter(a, b, k, k == self.depth)
            unknown = symbols == _SEPARATOR
            new_a, new_b = self.step(a, b, symbols)
            while (stuck := (new_a >= new_b) & ~unknown & (k > 0)).any():
                a, b, k = self._shorter(a, b, k, stuck)
                new_a[stuck], new_b[stuck] = self.step(a[stuck], b[stuck], symbols[stuck])
            k = np.where(unknown, 0, k + 1)
            lo[:active], hi[:active] = np.where(unknown, 0, new_a), np.where(unknown, self.n, new_b)
            have[:active] = k
            length[at], row[at] = k, lo[:active]
        return length, row

    def _shorter(self, lo, hi, have, which):
        for depth in np.unique(have[which]):
            some = which & (have == depth)
            start, end = self.block(int(depth) - 1)
            lo[some], hi[some] = start[lo[some]], end[lo[some]]
            have[some] -= 1
        return lo, hi, have
