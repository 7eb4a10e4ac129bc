"""Repeats by threshold-bounded interval expansion: breadth-first backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Symbols packed into one sort key: nine bits each (a byte plus one; zero ends a text).
PACKED = 7


def suffix_order(symbol: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts that end in zero each, and whether the first ``PACKED`` symbols differ from the suffix before.

    ``left``: symbols before the end of the own text. Suffixes are ordered up to their end, equal ones by
    position; ranks double in length, and only suffixes that are still tied are sorted again.
    """
    n = len(symbol)
    padded = np.r_[symbol, np.zeros(PACKED, symbol.dtype)].astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key = key << 9 | np.where(left >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    differs = np.ones(n, bool)
    differs[1:] = key[order[1:]] != key[order[:-1]]
    first = differs.copy()
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(differs)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    step, longest = PACKED, int(left.max()) if n else 0
    while step <= longest:
        tied = ~differs | ~np.r_[differs[1:], True]  # members of groups of two and more
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        further = np.where(left[some] >= step, rank[np.minimum(some + step, n - 1)] + 1, 0)
        group = rank[some]  # rising; a stable sort leaves ties in the order of their places
        sorting = np.argsort(group * (n + 1) + further, kind="stable")
        some, further, group = some[sorting], further[sorting], group[sorting]
        order[at] = some
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        if new.sum() == differs[at].sum():
            # nothing was told apart; longer prefixes may still differ
            step *= 2
            continue
        differs[at] = new
        begin = np.flatnonzero(new)
        rank[some] = np.repeat(at[begin], np.diff(np.r_[begin, len(at)]))
        step *= 2
    return order, first


def classes(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of texts (bytes end to end, ``ends`` exclusive) with ``length`` bytes left, and the class of each.

    Two positions have one class exactly if their ``length``-byte strings are equal. Common-prefix values of neighbouring
    suffixes are derived in increasing order: an interval of suffixes that begin with w is extended backward by every
    symbol c before them, which gives the interval of cw; where its end is not yet marked, the common
    prefix there is as long as w, and the interval is extended in turn. At ``length`` this stops; suffixes without
    a mark between them agree in so many bytes.
    """
    sizes = np.diff(np.r_[0, ends])
    n = len(data) + len(ends)
    text_of = np.repeat(np.arange(len(ends)), sizes + 1)
    symbol = np.zeros(n, np.int16)
    inner = np.ones(n, bool)
    inner[ends + np.arange(len(ends))] = False
    symbol[inner] = data.astype(np.int16) + 1
    left = (ends + np.arange(len(ends)))[text_of] - np.arange(n)
    order, first = suffix_order(symbol, left)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    bwt = np.where(order > 0, symbol[order - 1], 0)  # zero: no symbol of the own text before
    to = place[order - 1]
    # the next and the previous suffix with the same symbol before it
    by = np.argsort(bwt, kind="stable")
    same = bwt[by[1:]] == bwt[by[:-1]]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    later[by[:-1][same]] = by[1:][same]
    earlier[by[1:][same]] = by[:-1][same]
    marked = np.append(first, True)
    low = np.flatnonzero(first)
    high = np.r_[low[1:], n] - 1
    for _ in range(PACKED, length):
        if not len(low):
            break
        size = high - low + 1
        ends_at = np.cumsum(size)
        members = np.arange(ends_at[-1]) + np.repeat(low - (ends_at - size), size)
        before = bwt[members] > 0
        lowest = members[before & (earlier[members] < np.repeat(low, size))]
        highest = members[before & (later[members] > np.repeat(high, size))]
        low, high = np.sort(to[lowest]), np.sort(to[highest])  # intervals of one length are apart, so they pair up in order
        fresh = ~marked[high + 1]
        low, high = low[fresh], high[fresh]
        marked[high + 1] = True
    number = np.cumsum(marked[:-1]) - 1
    whole = np.flatnonzero(left >= length)
    return (whole - text_of[whole]), number[place[whole]]
