"""Suffix arrays of single texts by prefix doubling, with longest common prefixes, all in numpy."""

from __future__ import annotations

import numpy as np

from fiscalis.llm.induced import permuted_lcp


def repeats(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, int]:
    """The union of the spans of all maximal repeated substrings of at least `shortest` symbols, as rows (start, end), and the length of the longest repeat (0 if none).

    Ranks by the first 1, 2, 4, ... symbols are sorted until every suffix has its place; suffixes whose place is settled
    are not sorted again. Permuted common prefixes then need the final places alone, so memory is a few arrays of the
    text's length, whatever its repeats. A suffix is in an interval of prefixes of l symbols exactly if a neighbour shares
    l symbols with it, so the spans of the deepest interval of each suffix cover what all maximal repeats cover.
    Occurrences may overlap.
    """
    n = len(symbols)
    none = np.zeros((0, 2), np.int64), 0
    if n <= shortest:
        return none
    key, bits = _ranked(symbols)
    width = 1
    while width * 2 * bits <= 62:
        key = _joined(key, width, width * bits)
        width *= 2
    order = np.argsort(key)
    rank, tied = _ranks(key, order)
    del key
    while width < n and len(tied):
        # tied: the slots of the suffix array whose suffixes share their first `width` symbols with a neighbour
        at = order[tied]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + after
        inner = np.argsort(key)
        order[tied] = at[inner]
        tied = _refined(rank, order, tied, key[inner])
        width *= 2
    shared = permuted_lcp(symbols, order)  # with the suffix before it in the array
    at = np.nonzero(shared >= shortest)[0]
    if not len(at):
        return none
    common = shared[at]
    deepest = np.zeros(n, np.int64)
    deepest[at] = common
    before = order[rank[at] - 1]
    deepest[before] = np.maximum(deepest[before], common)  # a suffix comes before one other only
    start = np.nonzero(deepest)[0]
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + deepest[start], minlength=n + 1)
    inside = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.stack([np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]], axis=1), int(common.max())


def _ranked(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols as 1, 2, ... in their order, and the bits that these take; 0 is free for what lies behind the end."""
    most = int(symbols.max())
    if most < 1 << 16:
        seen = np.zeros(most + 1, np.int64)
        seen[symbols] = 1
        level = np.cumsum(seen)[symbols]
    else:
        level = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    return level, int(level.max()).bit_length()


def _joined(level: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Values for twice the width."""
    out = level << bits
    out[:-width] |= level[width:]
    return out


def _ranks(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's rank, the first slot of its group of equal keys, and the slots in groups of two or more."""
    n = len(order)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    return rank, np.nonzero(~(new & last))[0]


def _refined(rank: np.ndarray, order: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks the tied suffixes by their new key, in place; returns the slots that are still tied."""
    m = len(tied)
    new = np.ones(m, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, tied, 0))
    rank[order[tied]] = head
    last = np.ones(m, bool)
    last[:-1] = new[1:]
    return tied[~(new & last)]
