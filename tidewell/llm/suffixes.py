"""Suffix arrays by induced sorting, recursive on the names of leftmost-smaller substrings, and permuted common prefixes.

Whole buckets are induced at a time, which is quick where codes are few for their length, as bytes are. A level of
many codes is induced suffix by suffix, up to SINGLY of them; a longer one (the names of a shard's first level) is
sorted by doubling, which takes a quarter of the time (see README).
"""

from __future__ import annotations

import numpy as np

from .fmindex import suffix_array as doubled

#: Batches of fewer suffixes than this are induced one by one; a level of more codes than its length by this is, too, up to so many.
SMALL, CODES, SINGLY = 24, 48, 50_000


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one (S), False where greater (L); the last is S."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def induce(t: np.ndarray, s: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order that follows from the order of the leftmost-smaller suffixes `lms`: greater suffixes by a scan to the right, smaller ones to the left."""
    n, sigma = len(t), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    order = np.argsort(t[lms], kind="stable")
    counts = np.bincount(t[lms], minlength=sigma)
    seeds = lms[order]
    seed_at = np.concatenate([[0], np.cumsum(counts)])
    filled = starts.copy()

    def put(batch: np.ndarray, greater: bool, edge: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[s[j] != greater]
        if len(j):
            c = t[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], c[by]
            heads = np.flatnonzero(np.diff(c, prepend=-1))
            sizes = np.diff(np.append(heads, len(c)))
            within = np.arange(len(c)) - np.repeat(heads, sizes)
            own = c[heads]
            if greater:
                sa[np.repeat(edge[own], sizes) + within] = j
                edge[own] += sizes
            else:
                sa[np.repeat(edge[own], sizes) - 1 - within] = j
                edge[own] -= sizes

    for c in range(sigma):
        if starts[c] == ends[c]:
            continue
        at = starts[c]
        while at < filled[c]:
            if filled[c] - at < SMALL:  # a run of one code gives one suffix after the other
                j = sa[at] - 1
                at += 1
                if j >= 0 and not s[j]:
                    sa[filled[t[j]]] = j
                    filled[t[j]] += 1
                continue
            at, batch = filled[c], sa[at : filled[c]]
            put(batch, True, filled)
        put(seeds[seed_at[c] : seed_at[c + 1]], True, filled)
    tails = ends.copy()
    for c in range(sigma - 1, -1, -1):
        if starts[c] == ends[c]:
            continue
        at = ends[c]
        while at > tails[c]:
            if at - tails[c] < SMALL:
                at -= 1
                j = sa[at] - 1
                if j >= 0 and s[j]:
                    tails[t[j]] -= 1
                    sa[tails[t[j]]] = j
                continue
            at, batch = tails[c], sa[tails[c] : at][::-1]
            put(batch, False, tails)
        put(sa[starts[c] : filled[c]][::-1], False, tails)
    sa[0] = n - 1  # the closing code's suffix
    return sa


def induce_singly(codes: np.ndarray, types_: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As `induce`, suffix by suffix."""
    n, before = len(codes), codes[:-1]
    # The code before a place, if the suffix there is of the kind that a scan induces; place 0 has none and stands for an empty one too.
    greater = np.concatenate([[-1], np.where(types_[:-1], -1, before)]).tolist()
    smaller = np.concatenate([[-1], np.where(types_[:-1], before, -1)]).tolist()
    sa, tails = [0] * n, ends.tolist()
    for j, c in zip(lms[::-1].tolist(), codes[lms[::-1]].tolist(), strict=True):
        tails[c] -= 1
        sa[tails[c]] = j
    heads = [0, *ends[:-1].tolist()]
    for i in range(n):
        c = greater[sa[i]]
        if c >= 0:
            sa[heads[c]] = sa[i] - 1
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, 0, -1):
        c = smaller[sa[i]]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = sa[i] - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of codes that end with 0, which occurs nowhere else. Names of leftmost-smaller substrings are sorted as a string of their own, at every level until they are all different."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int64)
    s = types(t)
    ends = np.cumsum(np.bincount(t))
    few = len(ends) * CODES < n
    if not few and n > SINGLY:
        return doubled(t)
    induced = induce if few else induce_singly
    mark = np.zeros(n, bool)
    mark[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(mark)
    sa = induced(t, s, ends, lms)
    sorted_lms = sa[mark[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(lms[1:], n) - lms
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    on, k = np.flatnonzero(same), 0
    while len(on):  # up to and with the next leftmost-smaller place
        ok = t[np.minimum(a[on] + k, n - 1)] == t[np.minimum(b[on] + k, n - 1)]
        same[on[~ok]] = False
        on = on[ok & (length[a[on]] > k)]
        k += 1
    if not same.any():  # the substrings' order is the suffixes'
        return induced(t, s, ends, sorted_lms) if len(lms) > 1 else sa
    name = np.zeros(n, np.int64)
    name[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    return induced(t, s, ends, lms[by_names(name[lms])])


def by_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, of which the last is least and found once.

    A name found once tells its suffix's place, and ends the comparison of those before it: the names that repeat, and
    the one behind each run of them, are the string of the next level.
    """
    several = np.bincount(names)[names] > 1
    kept = several.copy()
    kept[1:] |= several[:-1]
    kept[-1] = True
    _, codes = np.unique(names[kept], return_inverse=True)
    rank = np.zeros(len(names), np.int64)
    rank[np.flatnonzero(kept)[suffix_array(codes)]] = np.arange(len(codes))
    return np.lexsort((rank, names))


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of `data`, how many bytes (at most `most`) the suffix there has in common with the one before it in the order of `sa`; permuted to the order of the text.

    `sa` may list some of the places only; the others, and its first, have 0. Bytes beyond the end differ from all.
    """
    out = np.zeros(len(data), np.int32)
    a, b = sa[:-1], sa[1:]
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    on, length = np.arange(len(a)), np.full(len(a), most, np.int32)
    for k in range(0, most, 8):
        x = np.ascontiguousarray(word[a[on] + k]).view("<u8").ravel() ^ np.ascontiguousarray(word[b[on] + k]).view("<u8").ravel()
        differ = np.flatnonzero(x)
        low = x[differ] & (~x[differ] + np.uint64(1))  # the lowest bit that differs tells the first byte
        length[on[differ]] = k + np.bitwise_count(low - np.uint64(1)) // 8
        on = on[x == 0]
        if not len(on):
            break
    out[b] = np.minimum(length, np.minimum(most, len(data) - np.maximum(a, b)))
    return out


def repeated(data: np.ndarray, sa: np.ndarray, valid: np.ndarray, n: int) -> np.ndarray:
    """Which places i of `data` start n bytes that start at another valid place too."""
    sa = sa[sa < len(data)]
    sa = sa[valid[sa]]  # equal windows are neighbours among valid places
    out = common_prefixes(data, sa, n) >= n
    if len(sa):
        out[sa[:-1]] |= out[sa[1:]]
    return out
