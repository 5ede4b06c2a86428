"""Words of a batch of texts as arrays: where they lie, their hashes, and hashes of runs of words.

All of it works on the UTF-8 bytes of a whole batch at once. Hashes are polynomial sums modulo 2**64,
taken from running sums, then mixed. Two multipliers give two independent hashes.
"""

from __future__ import annotations

import numpy as np

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words: all but blank and 09 to 0D; digits, a to z and all beyond ASCII.
NOT_BLANK = ~_WHITE
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse modulo 2**64, for i below n; a process keeps the longest it has needed, up to 4 million."""
    got = _KEPT.get(multiplier)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            x = np.full(size if size <= 1 << 22 else n, m, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        got = out[0], out[1]
        if size <= 1 << 22:
            _KEPT[multiplier] = got
    return got[0][:n], got[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(33)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte places) of the words of all texts, in order, and the n + 1 bounds of each text's words."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data), multiplier)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=sums[1:], casting="unsafe")
    sums[1:] *= up
    np.cumsum(sums[1:], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Hash of each run of n consecutive words (runs across texts included), by its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words), multiplier)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """First words of all runs of n words that lie in one text."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    return np.repeat(bounds[:-1], counts) + ragged(counts)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) if total else np.zeros(0, np.int64)
