"""Suffix array by induced sorting and permuted longest common prefixes, on numpy arrays of one shard.

The scans of induced sorting run bucket by bucket: all entries of a bucket that are known are taken at once, which keeps
their order, so a pass costs a few array steps per letter instead of one step per suffix."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S); the last one is larger than the empty suffix (L)."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        up = t[:-1][differs] < t[1:][differs]
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        s[:-1][inside] = up[at[inside]]
    return s


def _induce(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array (or an order of leftmost-smaller substrings) from sorted leftmost-smaller suffixes."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, np.int64)
    lms_char = t[lms]
    by_char = np.argsort(lms_char, kind="stable")
    lms_sorted, lms_at = lms[by_char], np.searchsorted(lms_char[by_char], np.arange(sigma + 1))
    head = begin.copy()

    def put(entries: np.ndarray, heads: np.ndarray, step: int) -> None:
        ch = t[entries]
        order = np.argsort(ch, kind="stable")
        ch = ch[order]
        new = np.flatnonzero(np.r_[True, ch[1:] != ch[:-1]])
        sizes = np.diff(np.r_[new, len(ch)])
        place = np.arange(len(ch)) - np.repeat(new, sizes)
        sa[heads[ch] + step * place] = entries[order]
        heads[ch[new]] += step * sizes

    put(np.array([n - 1]), head, 1)
    used = np.flatnonzero(count)
    for c in used:  # larger suffixes, left to right
        done = begin[c]
        while done < head[c]:
            batch = sa[done:head[c]]
            done = head[c]
            prev = batch[batch > 0] - 1
            prev = prev[~small[prev]]
            if len(prev):
                put(prev, head, 1)
        if lms_at[c] < lms_at[c + 1]:
            put(lms_sorted[lms_at[c]:lms_at[c + 1]] - 1, head, 1)
    tail = end - 1
    larger_end = head
    for c in used[::-1]:  # smaller suffixes, right to left
        done = end[c] - 1
        while done > tail[c]:
            batch = sa[tail[c] + 1:done + 1][::-1]
            done = tail[c]
            prev = batch[batch > 0] - 1
            prev = prev[small[prev]]
            if len(prev):
                put(prev, tail, -1)
        batch = sa[begin[c]:larger_end[c]][::-1]
        prev = batch[batch > 0] - 1
        prev = prev[small[prev]]
        if len(prev):
            put(prev, tail, -1)
    return sa


def _by_ranks(names: np.ndarray) -> np.ndarray:
    """Suffixes of the reduced string: ranks of prefixes are joined to ranks of prefixes of twice the length, until
    they all differ. (Its alphabet is as large as itself, so buckets would hold single entries.)"""
    n, rank, k = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, letters 0 .. sigma - 1; a shorter suffix is smaller than its extensions."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        order = _induce(t, small, sigma, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        length = np.empty(n, np.int64)
        length[lms] = np.diff(np.r_[lms, n - 1]) + 1  # to the next leftmost-smaller letter
        a, b = order[:-1], order[1:]
        equal = length[a] == length[b]
        equal &= (a != lms[-1]) & (b != lms[-1])  # the last one ends with the text
        live, d = np.flatnonzero(equal), 0
        while len(live):
            live = live[length[a[live]] > d]
            wrong = t[a[live] + d] != t[b[live] + d]
            equal[live[wrong]] = False
            live = live[~wrong]
            d += 1
        name_at = np.empty(n, np.int64)
        name_at[order] = np.r_[0, np.cumsum(~equal)]
        lms = order if not equal.any() else lms[_by_ranks(name_at[lms])]
    return _induce(t, small, sigma, lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, before): for each position the suffix before it in order (-1 for the first) and their common prefix.
    Where the letters before both are equal, the value is that of the position before, less one; the others
    (irreducible) are compared letter by letter, which sums to n log n at most."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    where = np.arange(n)
    irreducible = (before <= 0) | (where == 0)
    rest = np.flatnonzero(~irreducible)
    irreducible[rest] = t[rest - 1] != t[before[rest] - 1]
    lcp = np.zeros(n, np.int64)
    padded = np.r_[t.astype(np.int16), np.full(64, -1, np.int16)]
    live = np.flatnonzero(irreducible & (before >= 0))
    step = np.arange(32)
    while len(live):
        waiting = []
        for s in range(0, len(live), 1 << 14):
            i = live[s:s + (1 << 14)]
            at = lcp[i]
            differ = padded[(i + at)[:, None] + step] != padded[(before[i] + at)[:, None] + step]
            any_ = differ.any(1)
            lcp[i] += np.where(any_, differ.argmax(1), 32)
            waiting.append(i[~any_])
        live = np.concatenate(waiting)
    start = np.maximum.accumulate(np.where(irreducible, where, 0))
    return np.maximum(lcp[start] - (where - start), 0), before
