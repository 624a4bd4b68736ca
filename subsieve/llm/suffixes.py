"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost smaller suffixes (LMS) are put in
order by naming their substrings and sorting the names recursively; all others follow by induction, from left to right
for L and from right to left for S. On bytes, a bucket (a first symbol) is induced at once with numpy: what a bucket
adds to itself are runs of its symbol, taken in waves; everything else lands in buckets that come later. Names are too
many for that, so the recursion goes symbol by symbol.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in order; s holds small non-negative numbers, and a shorter suffix that
    begins a longer one comes first."""
    s = np.append(np.asarray(s, np.int32) + 1, np.int32(0))  # a smallest last symbol
    if len(s) == 1:
        return np.zeros(0, np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = _induced(s, small, lms)
    ordered = ordered[np.isin(ordered, lms, kind="table")] if len(lms) else ordered
    names = _names(s, ordered, lms)
    of = np.empty(len(s), np.int64)
    of[ordered] = names
    reduced = of[lms]
    if names[-1] + 1 < len(lms):
        ordered = lms[np.array(_by_symbol(reduced.tolist(), int(names[-1]) + 1), np.int64)]
    return _induced(s, small, ordered)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one counts as smaller."""
    step = np.append(np.sign(np.diff(s.astype(np.int64))), 1)
    at = np.where(step != 0, np.arange(len(s)), len(s) - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return step[following] > 0


def _induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (or LMS substrings, from LMS suffixes in any order)."""
    n, sizes = len(s), np.bincount(s)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int64)
    symbols = s[lms]
    count = np.bincount(symbols, minlength=len(sizes))
    order = np.argsort(symbols, kind="stable")
    first = np.repeat(ends - count, count)
    out[first + np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)] = lms[order]
    lows, heads = ends - count, starts.copy()

    def put(found: np.ndarray, kind: bool, edge: np.ndarray, up: bool) -> None:
        before = found[found > 0] - 1
        before = before[small[before] == kind]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        c = c[order]
        begin = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        number = np.diff(np.append(begin, len(c)))
        rank = np.arange(len(c)) - np.repeat(begin, number)
        at = edge[c] + rank if up else edge[c] - 1 - rank
        out[at] = before[order]
        edge[c[begin]] += number if up else -number

    used = np.flatnonzero(sizes)
    for c in used:
        at = starts[c]
        while at < heads[c]:
            at, found = heads[c], out[at : heads[c]]
            put(found, False, heads, True)
        put(out[lows[c] : ends[c]], False, heads, True)
    tails = ends.copy()
    for c in used[::-1]:
        at = ends[c]
        while at > tails[c]:
            at, found = tails[c], out[tails[c] : at][::-1]
            put(found, True, tails, False)
        put(out[starts[c] : heads[c]][::-1], True, tails, False)
    out[0] = n - 1  # the last symbol is its own bucket and isn't induced by any other
    return out


def _names(s: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in order: the same for equal neighbours, else one more."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    live = np.flatnonzero(length[a] == length[b])
    equal, d = np.zeros(len(a), bool), 0
    equal[live] = True
    while len(live):
        same = s[a[live] + d] == s[b[live] + d]
        equal[live[~same]] = False
        d += 1
        live = live[same & (length[a[live]] > d)]
    return np.append(0, np.cumsum(~equal))


def _by_symbol(s: list[int], names: int) -> list[int]:
    """Suffixes in order of a list of numbers below `names`, whose last one is the only 0."""
    n, text = len(s), np.array(s, np.int64)
    types = _types(text)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    small, ends = types.tolist(), np.cumsum(np.bincount(text, minlength=names)).tolist()

    def induced(some: list[int]) -> list[int]:
        out = [-1] * n
        tails = ends[:]
        for i in reversed(some):
            tails[s[i]] -= 1
            out[tails[s[i]]] = i
        heads = [0, *ends[:-1]]
        for i in out:  # what is put in comes up later in the same pass
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                out[heads[c]] = i - 1
                heads[c] += 1
        tails = ends[:]
        for i in reversed(out):
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                tails[c] -= 1
                out[tails[c]] = i - 1
        out[0] = n - 1
        return out

    if not len(lms):
        return induced([])
    is_lms, of = np.zeros(n, bool), np.empty(n, np.int64)
    is_lms[lms] = True
    ordered = np.array(induced(lms.tolist()), np.int64)
    ordered = ordered[is_lms[ordered]]
    of[ordered] = found = _names(text, ordered, lms)
    if found[-1] + 1 < len(lms):
        ordered = lms[_by_symbol(of[lms].tolist(), int(found[-1]) + 1)]
    return induced(ordered.tolist())


def permuted_prefixes(s: np.ndarray, order: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in the order of the text: the suffix before it in order (-1: none), and how many symbols both
    begin with, up to a symbol `stop` or below, which ends a text.

    Only suffixes whose symbol before differs from that of the one before in order are compared; after another suffix
    a common prefix is one shorter than that of the suffix to its left.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    i = np.arange(n)
    left, mate = s[np.maximum(i - 1, 0)], s[np.maximum(phi - 1, 0)]
    fresh = (i == 0) | (phi <= 0) | (left != mate) | (left <= stop)
    at = np.flatnonzero(fresh & (phi >= 0))
    common = np.zeros(n, np.int64)
    live, d = at, 0
    while len(live):
        a, b = live + d, phi[live] + d
        live, a, b = (x[(a < n) & (b < n)] for x in (live, a, b))
        live = live[(s[a] == s[b]) & (s[a] > stop)]
        d += 1
        common[live] = d
    start = np.maximum.accumulate(np.where(fresh, i, 0))
    return phi, np.maximum(common[start] - (i - start), 0)
