"""Compressed FM-index over numbers: bit-packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions ordered by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    size, order = 1, np.argsort(rank, kind="stable")
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        size *= 2
        if rank[order[-1]] == n:
            break
    return order


class Bits:
    """A packed bit vector with the counts of ones in front of every word."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """``text`` holds numbers from 0; patterns of fewer than ``depth`` symbols can be searched."""
        order = sorted_suffixes(text, depth)
        symbols = int(text.max()) + 1 if len(text) else 1
        last = text[order - 1]  # the symbol in front of the first suffix is the last one, a separator
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(bool)), int(len(bit) - bit.sum())))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(symbols)
        self.base = self.down(every, np.zeros(symbols, np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more symbol in front."""
        base = self.first[symbol] - self.base[symbol]
        return base + self.down(symbol, low), base + self.down(symbol, high)

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text at the positions ``ends``.

        For each, the length (at most ``most``) of the longest match that ends there and occurs
        ``least`` times in the index, and the first row of a match of full length.
        """
        length, row = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for back in range(most):
            low, high = self.step(text[ends[alive] - back], low, high)
            still = high - low >= least
            alive, low, high = alive[still], low[still], high[still]
            length[alive] = back + 1
            if not len(alive):
                break
        else:
            row[alive] = low
        return length, row
