"""Byte-pair merging with a heap of pairs and a linked list of symbols."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush


def merge(symbols: list[str], rank: Callable[[tuple[str, str]], float | None]) -> int:
    """Merge adjacent symbols in place, lowest rank first, leftmost among equals.

    ``rank`` gives a pair's rank or None. Merged-away symbols become None; the others, in order, are
    the tokens. Returns the number of merges, so tokens = symbols before - merges.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank((symbols[i], symbols[i + 1]))
        if r is not None:
            heap.append((r, i, symbols[i], symbols[i + 1]))
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one side has been merged since
        symbols[i], symbols[j] = left + right, None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            r = rank((symbols[i], symbols[k]))
            if r is not None:
                heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            r = rank((symbols[h], symbols[i]))
            if r is not None:
                heappush(heap, (r, h, symbols[h], symbols[i]))
    return merges
