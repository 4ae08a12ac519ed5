"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of bytes.

The suffixes are classified as smaller (S) or larger (L) than their right neighbour. The substrings between leftmost S
suffixes are sorted by inducing, named, and, where names repeat, sorted by a recursive call on the string of names. The
sorted leftmost S suffixes then induce the L suffixes in one scan upwards and the S suffixes in one scan downwards.

A scan looks at each suffix once, at every level of the recursion, a batch of consecutive buckets at a time: buckets of
which none hands anything to another one of the batch. What a batch hands out goes to its buckets in one stable step. The
suffixes that a bucket hands to itself are runs of one symbol, and come in the order of their distance to the run's end.
A string of a million bytes takes some thousand batches in all; at worst a bucket is a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np

#: A byte that UTF-8 never has; it ends each text of a shard.
END = 0xFF


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a byte array, the empty suffix left out. A suffix that is a prefix of another sorts before it."""
    s = np.zeros(len(text) + 1, np.int32)  # 0 at the end is smaller than all else
    s[:-1] = text
    s[:-1] += 1
    return _sorted(s)[1:]


def permuted_lcp(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the symbols that it shares with the suffix before it in the suffix array.

    A suffix whose left neighbour equals that of its predecessor in the array shares one symbol less than the suffix to
    its left, so place plus prefix carries over from left to right. Only the other suffixes are compared; what they
    share adds up to n log n at most.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    at = np.nonzero(before[1:] > 0)[0] + 1
    carried[at] = symbols[at - 1] == symbols[before[at] - 1]
    at = np.nonzero(~carried & (before >= 0))[0]
    until = np.arange(n)
    until[at] += _shared(symbols, at, before[at])
    until[carried] = 0
    return np.maximum.accumulate(until) - np.arange(n) if n else until


def _shared(symbols: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The symbols that each pair of suffixes shares: 8 at a time for many pairs, in growing blocks for the last few."""
    n = len(symbols)
    got = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)])
    step = np.arange(8)
    while len(alive) > 64:
        a, b = left[alive] + got[alive], right[alive] + got[alive]
        same = padded[np.minimum(a, n)[:, None] + step] == padded[np.minimum(b, n)[:, None] + step]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        run = np.minimum(run, n - np.maximum(a, b))
        got[alive] += run
        alive = alive[run == 8]
    for k in alive.tolist():
        a, b, size = int(left[k] + got[k]), int(right[k] + got[k]), 64
        while max(a, b) < n:
            size = min(size * 2, 1 << 20)
            m = min(size, n - max(a, b))
            unlike = symbols[a : a + m] != symbols[b : b + m]
            run = int(unlike.argmax()) if unlike.any() else m
            got[k] += run
            a, b = a + run, b + run
            if run < m:
                break
    return got


def _flag(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the suffix to the right."""
    n = len(s)
    step = np.sign(s[1:] - s[:-1])  # > 0: S, < 0: L, 0: as the next
    known = np.nonzero(step)[0]
    small = np.ones(n, bool)
    if len(known):
        nearest = np.searchsorted(known, np.arange(n - 1))
        small[:-1] = step[known[np.minimum(nearest, len(known) - 1)]] > 0
    return small


def _named(s: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_sorted: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in order, of the substrings from one leftmost S suffix to the next, by position; and how many there are."""
    n = len(s)
    end = np.full(n, n - 1, np.int64)
    end[lms[:-1]] = lms[1:]
    a, b = lms_sorted[:-1], lms_sorted[1:]
    unlike = (end[a] - a) != (end[b] - b)
    unlike |= (a == n - 1) | (b == n - 1)
    at, k = np.nonzero(~unlike)[0], 0
    while len(at):
        x, y = a[at] + k, b[at] + k
        differ = s[x] != s[y]
        unlike[at[differ]] = True
        at = at[~differ & (x < end[a[at]])]
        k += 1
    names = np.zeros(n, np.int32)
    names[lms_sorted] = np.concatenate([[0], np.cumsum(unlike)])
    return names, int(unlike.sum()) + 1


def _sorted(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string whose last symbol is its only smallest."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _classify(s)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    inner = small.copy()
    inner[n - 1] = False  # nothing induces the end
    upwards, downwards = _scan(s, ~small), _scan(s.max() - s, inner)
    smalls = downwards(upwards(lms[np.argsort(s[lms], kind="stable")])[::-1])[::-1]
    lms_sorted = np.concatenate([lms[-1:], smalls[_flag(lms, n)[smalls]]])
    names, distinct = _named(s, small, lms, lms_sorted)
    if distinct < len(lms):
        lms_sorted = lms[_sorted(names[lms])]  # the last name, the end, is the smallest
    larges = upwards(lms_sorted)
    smalls = downwards(larges[::-1])[::-1]
    order = np.empty(n, np.int64)
    order[0] = n - 1
    of_larges, of_smalls = s[larges], s[smalls]  # in a bucket, L suffixes come before S suffixes
    lower = np.concatenate([[0], np.cumsum(np.bincount(of_smalls, minlength=s.max() + 1))])
    order[np.arange(1, len(larges) + 1) + lower[of_larges]] = larges
    upto = np.cumsum(np.bincount(of_larges, minlength=s.max() + 1))
    order[np.arange(1, len(smalls) + 1) + upto[of_smalls]] = smalls
    return order


def _scan(s: np.ndarray, wanted: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from the given suffixes, in order, to the wanted ones, in order. A wanted suffix has a symbol as large as that of the suffix to its right, or larger, and that one is wanted or given; given ones come last in their bucket."""
    n, top = len(s), int(s.max()) + 1
    members = np.nonzero(wanted)[0]
    to, by = s[members], s[members + 1]
    apart = to != by
    left = np.full(n, -1, np.int32)  # the bucket to which a suffix hands its left neighbour
    left[members[apart] + 1] = to[apart]
    edge = np.zeros(n, np.int64)
    edge[1:] = np.where(s[1:] != s[:-1], np.arange(1, n), 0)
    run = np.arange(n) - np.maximum.accumulate(edge)  # equal symbols to the left, which a wanted suffix hands to its own bucket
    run[~wanted] = 0
    own = np.bincount(to, minlength=top)
    feeds = np.concatenate([[0], np.cumsum(np.bincount(to[~apart], minlength=top))])
    source = np.full(top, -1, s.dtype)
    np.maximum.at(source, to[apart].astype(np.intp), by[apart])
    cuts = [0]
    for bucket, nearest in enumerate(source.tolist()):  # the nearest bucket that hands something to this one
        if nearest >= cuts[-1]:
            cuts.append(bucket)
    cuts.append(top)
    narrow = np.uint16 if top <= 1 << 16 else np.int32  # numpy sorts 16 bits by radix

    def induced(given: np.ndarray) -> np.ndarray:
        theirs = s[given]
        begin = np.concatenate([[0], np.cumsum(own + np.bincount(theirs, minlength=top))])
        line = np.empty(begin[-1], np.int64)
        at = np.arange(len(given)) + np.cumsum(own)[theirs]
        line[at] = given
        head = begin[:-1].copy()

        def put(found: np.ndarray, bucket: np.ndarray) -> None:
            order = np.argsort(bucket.astype(narrow), kind="stable")
            bucket = bucket[order]
            new = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
            count = np.diff(np.append(new, len(bucket)))
            to = bucket[new]
            line[np.arange(len(bucket)) + np.repeat(head[to] - new, count)] = found[order]
            head[to] += count

        for c, d in pairwise(cuts):
            if feeds[d] > feeds[c]:
                now = np.concatenate([line[begin[b] : head[b]] for b in range(c, d) if feeds[b + 1] > feeds[b]])
                more = run[now]
                now, more = now[more > 0], more[more > 0]
                far = np.arange(1, more.sum() + 1) - np.repeat(np.cumsum(more) - more, more)
                order = np.argsort(far, kind="stable")
                found = (np.repeat(now, more) - far)[order]
                put(found, s[found])
            now = line[begin[c] : begin[d]]
            bucket = left[now]
            handed = bucket >= 0
            if handed.any():
                put(now[handed] - 1, bucket[handed])
        line[at] = -1
        return line[line >= 0]

    return induced
