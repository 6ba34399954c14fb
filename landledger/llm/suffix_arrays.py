"""Suffix arrays of word numbers by prefix doubling, in numpy.

``codes`` is a row of texts' word numbers in which every text is closed by a number that occurs nowhere else, so no
repeat reaches over an end.  Level k ranks the stretches of 2**k words: two places have one rank exactly if their
stretches are equal, and ranks are the places of such groups in the suffix order.  Only groups of two or more are sorted
again, so a level costs what still repeats.  The levels answer how far two places agree, forwards and backwards, by a
descent over powers of two.

Memory: 4 bytes a word for each doubling up to the longest repeat.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def closed(words: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``words`` (numbers below ``most``) with a closing number behind each text, and where each text starts in that row."""
    lengths = np.diff(ends, prepend=0)
    codes = np.full(len(words) + len(ends), most, np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    closing = starts + lengths
    inside = np.ones(len(codes), bool)
    inside[closing] = False
    codes[inside] = words
    codes[closing] = most + np.arange(len(ends))
    return codes, starts


class SuffixArray(NamedTuple):
    order: np.ndarray
    levels: list[np.ndarray]
    #: Places that equal some other place over the last level's stretch; none if the order is final.
    open: np.ndarray

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` (never one place) on are equal, below twice the last level's stretch."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            n += (rank[a + n] == rank[b + n]).astype(np.int64) << k
        return n

    def common_suffix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are equal."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[k], a - n - (1 << k), b - n - (1 << k)
            n += ((np.minimum(x, y) >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])).astype(np.int64) << k
        return n

    def neighbours(self) -> np.ndarray:
        """The longest common prefix of each suffix and the one before it in the order (0 for the first)."""
        return np.concatenate([[0], self.common_prefix(self.order[:-1], self.order[1:])])[: len(self.order)]


def suffix_array(codes: np.ndarray, longest: int | None = None) -> SuffixArray:
    """The order by the first ``longest`` words at least (None: whole suffixes)."""
    size = len(codes)
    order = np.argsort(codes)
    sorted_codes = codes[order]
    head = np.append(True, sorted_codes[1:] != sorted_codes[:-1])[:size]
    first = np.maximum.accumulate(np.where(head, np.arange(size), 0))
    rank = np.empty(size, np.int32 if size < 2**31 else np.int64)
    rank[order] = first
    levels, width = [rank], 1
    single = head & np.append(head[1:], True)[:size]
    slots = np.flatnonzero(~single)
    while len(slots) and (longest is None or width < longest):
        at = order[slots]
        # closing numbers are groups of one, so every place here has a full stretch of words behind it
        key = rank[at].astype(np.int64) * (size + 1) + rank[at + width]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at  # a group keeps its slots, as the key starts with its rank
        head = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(head, slots, 0))
        rank = rank.copy()
        rank[at] = first
        levels.append(rank)
        width *= 2
        slots = slots[~(head & np.append(head[1:], True))]
    return SuffixArray(order, levels, order[slots])


def _earlier_neighbour(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the nearest one before it whose suffix starts earlier, and the words they share; ``common`` is what a slot shares
    with the one before it.  Pointers jump over pointers: each skips only suffixes that start later."""
    to, low = np.arange(len(order)) - 1, common.copy()
    going = np.flatnonzero((low > 0) & (order[to] > order))
    while len(going):
        mid = to[going]
        low[going], to[going] = np.minimum(low[going], low[mid]), to[mid]
        going = going[(low[going] > 0) & (order[to[going]] > order[going])]
    return to, low


def previous_factors(sa: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch from it that also starts earlier, and where (anything if the length is 0)."""
    common = sa.neighbours()
    left, of_left = _earlier_neighbour(sa.order, common)
    right, of_right = _earlier_neighbour(sa.order[::-1], np.append(common[1:], 0)[::-1])
    right, of_right = len(sa.order) - 1 - right[::-1], of_right[::-1]
    length, source = np.empty(len(sa.order), np.int64), np.empty(len(sa.order), np.int64)
    length[sa.order] = np.maximum(of_left, of_right)
    source[sa.order] = sa.order[np.where(of_left >= of_right, left, np.minimum(right, len(sa.order) - 1))]
    return length, source
