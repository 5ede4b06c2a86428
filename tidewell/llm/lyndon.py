"""Lyndon arrays by suffix grouping, and the runs of a sequence from their Lyndon roots.

Suffixes are put into groups of one context each: at first by their first word, then, group by group from the greatest
down, every suffix whose context is followed by that of the group takes it up, once for each time that it follows
(Baier, 2016, phase one). A suffix's context, when its group's turn comes, is its longest Lyndon prefix. Done under an
order of words and under its reverse, this gives a root of every run (Bannai et al., 2017).
"""

from __future__ import annotations

import numpy as np


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; `word` holds numbers from 0 on, and a place past the end counts as least.

    Time is linear but for sorting the moves of each step. Places are numbered from 1 here, 0 stands before all.
    """
    n = len(word)
    of = [0, *word]  # group of each place
    names = max(word, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(names)]
    for i, c in enumerate(word, 1):
        members[c].append(i)
    size, context = [len(m) for m in members], [1] * names
    below, above = list(range(-1, names - 1)), list(range(1, names + 1))
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # places not yet settled
    times, out = [0] * (n + 2), [0] * (n + 1)
    group = names - 1
    while group >= 0:
        length, met = context[group], []
        own = [i for i in members[group] if of[i] == group] if size[group] else ()
        for i in own:
            times[i] += 1
        # Each settled place hands its count to the unsettled place before it; the last of a row of equal contexts hands over all of them.
        for i in own:
            out[i] = length
            before, after = left[i], right[i]
            right[before], left[after] = after, before
            if not times[before]:
                met.append(before)
            times[before] += times[i]
        members[group] = ()
        moves: dict[tuple[int, int], list[int]] = {}
        for j in met:
            if j:
                moves.setdefault((times[j], of[j]), []).append(j)
            times[j] = 0
        for i in own:
            times[i] = 0
        for often, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            moved = moves[often, old]
            if len(moved) == size[old]:  # the whole group takes it up
                context[old] += often * length
                continue
            new = len(size)
            for j in moved:
                of[j] = new
            size[old] -= len(moved)
            size.append(len(moved))
            members.append(moved)
            context.append(context[old] + often * length)
            over = above[old]  # the group in turn at most
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
        group = below[group]
    return out[1:]


def common_prefix(word: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j on (i < j) are equal, exactly; read in blocks that double."""
    done, block, n = 0, 16, len(word)
    while j + done < n:
        width = min(block, n - j - done)
        unlike = np.flatnonzero(word[i + done : i + done + width] != word[j + done : j + done + width])
        if len(unlike):
            return done + int(unlike[0])
        done, block = done + width, block * 2
    return done


def runs(word: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `times` (two or more) periods, by start, then period.

    In a run of three periods two longest Lyndon words of its period's length, under one of the orders, lie side by side;
    the first of them that is met is extended both ways, and tells of the others that they are in the same run.
    """
    n, found = len(word), set()
    if n < least:
        return []
    _, names = np.unique(word, return_inverse=True)
    places = np.arange(n)
    for ranks in (names, names.max() - names):
        roots = np.array(lyndon_array(ranks.tolist()))
        next_ = np.minimum(places + roots, n - 1)
        side = np.flatnonzero((places + roots < n) & (roots[next_] == roots) & (word == word[next_]))
        reach: dict[int, int] = {}  # of each period: up to where words are known to equal those a period on
        for i, p in zip(side.tolist(), roots[side].tolist(), strict=True):
            if i < reach.get(p, 0):
                continue
            ahead = common_prefix(word, i, i + p)
            if ahead < p:
                continue
            reach[p] = i + ahead
            back = common_prefix(word[: i + p][::-1], 0, p)
            length = back + p + ahead
            if length >= max(least, times * p):
                found.add((i - back, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))
