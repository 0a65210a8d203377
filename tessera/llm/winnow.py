"""Winnowing: of each window of consecutive gram hashes keep the smallest, the rightmost among equals.

Any shared run of ``window + k - 1`` symbols shares at least one kept gram.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept grams of one sequence, ascending; fewer grams than a window are one window."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    # smallest hash first, then the largest place
    order = (hashes & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(n, dtype=U64))
    low = _sliding_min(order, min(window, n))
    return (U64(0xFFFFFFFF) - (low[np.r_[True, low[1:] != low[:-1]]] & U64(0xFFFFFFFF))).astype(np.int64)


def _sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while size * 2 <= window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (window - size)], values[window - size :]) if window > size else values


def kept_of_many(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept grams of many sequences side by side; ``first``: where each begins, then the end.

    Sequences with fewer grams than a window keep all.
    """
    n, counts = len(hashes), np.diff(first)
    mark = np.zeros(n, bool)
    for a in np.flatnonzero((counts > 0) & (counts < window)):
        mark[first[a] : first[a + 1]] = True
    if n >= window:
        order = (hashes & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(n, dtype=U64))
        low = _sliding_min(order, window)
        row = np.repeat(np.arange(len(counts)), counts)
        low = low[row[: len(low)] == row[window - 1 :]]
        mark[(U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.int64)] = True
    return np.flatnonzero(mark)
