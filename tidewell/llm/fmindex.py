"""An FM-index over the words of a shard: wavelet-tree ranks for backward search, sampled suffix positions to locate."""

from __future__ import annotations

import numpy as np

#: Every so many positions the suffix's place is kept.
SAMPLE = 16


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling; after each round only suffixes that still tie are sorted again."""
    n = len(codes)
    nxt = np.zeros(n, np.int64)
    nxt[:-1] = codes[1:] + 1
    key = codes.astype(np.int64) * (int(codes.max()) + 3) + nxt
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    place = np.repeat(heads, np.diff(np.append(heads, n)))  # a group's rank is the place of its first
    rank[order] = place
    reach = 2
    sizes = np.diff(np.append(heads, n))
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order whose group has more than one
    while len(open_):
        own = order[open_]
        group = rank[own]
        ahead = own + reach
        key2 = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((key2, group))
        own, group, key2 = own[by], group[by], key2[by]
        order[open_] = own
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (key2[1:] != key2[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(open_)))
        rank[own] = np.repeat(open_[heads], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return order


class Bits:
    """A bit vector with ranks: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[: len(small)] = small
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet tree in matrix form: at each level the zeros go before the ones, in order."""

    def __init__(self, codes: np.ndarray, width: int):
        self.levels, self.zeros, codes = [], [], codes.astype(np.int32)
        for b in range(width - 1, -1, -1):
            on = ((codes >> b) & 1).astype(bool)
            self.levels.append((b, Bits(on)))
            off = codes[~on]
            self.zeros.append(len(off))
            codes = np.concatenate([off, codes[on]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code occurs before place i."""
        start = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for (b, bits), zeros in zip(self.levels, self.zeros, strict=True):
            on = ((code >> b) & 1).astype(bool)
            a, e = bits.rank(start), bits.rank(i)
            start, i = np.where(on, zeros + a, start - a), np.where(on, zeros + e, i - e)
        return i - start

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at place i, and how often it occurs before."""
        code, start, i = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for (b, bits), zeros in zip(self.levels, self.zeros, strict=True):
            on = bits.get(i)
            code |= on.astype(np.int64) << b
            a, e = bits.rank(start), bits.rank(i)
            start, i = np.where(on, zeros + a, start - a), np.where(on, zeros + e, i - e)
        return code, i - start


class Index:
    """Over codes of at least 1, closed by a code 0 that occurs nowhere else."""

    def __init__(self, codes: np.ndarray):
        codes = np.append(codes, 0)
        order = suffix_array(codes)
        last = codes[order - 1]  # the last column; before the first symbol comes the closing one
        width = max(1, int(codes.max()).bit_length())
        self.tree = Wavelet(last, width)
        self.first = np.zeros((1 << width) + 1, np.int64)
        np.cumsum(np.bincount(codes, minlength=1 << width), out=self.first[1:])
        self.n = len(codes)
        kept = order % SAMPLE == 0
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern: its last `size` columns, read from behind."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((high > low) & (patterns.shape[1] - k <= sizes))
            if not len(on):
                continue
            code = patterns[on, k]
            ranks = self.tree.rank(np.concatenate([code, code]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.first[code] + ranks[: len(on)], self.first[code] + ranks[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes at these rows: steps to the suffix before until one is kept."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            on = self.kept.get(rows)
            out[left[on]] = self.places[self.kept.rank(rows[on])] + steps
            left, rows = left[~on], rows[~on]
            code, before = self.tree.get(rows)
            rows, steps = self.first[code] + before, steps + 1
        return out % self.n
