"""Byte-level word splitting and hashing for whole Arrow string columns.

A slice of a column is handled as one byte array: a table lookup marks word bytes and lower-cases
A-Z, run boundaries give the words, and a prefix sum of a polynomial gives each word's 64-bit hash.
No Python object is made for a word. Rows never leak into each other: a word ends with its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U64), np.ones(1, U64)]
#: Powers that a worker keeps (4 MB each way); longer texts make their own.
_KEPT_POWERS = 1 << 19


def _word_table(separators: set[int]) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.array([b not in separators for b in range(256)])
    lowered = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + U64(1)
    return is_word, lowered


#: Words are [^\x20\x09-\x0D]+
SPACE_SPLIT = _word_table({0x20, *range(0x09, 0x0E)})
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, so A-Z count as letters here.
ALNUM_SPLIT = _word_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


class Words(NamedTuple):
    """Words of some rows: byte range, row and hash of each, and the first word of each row (one more than rows)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for later calls up to _KEPT_POWERS."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n if n > _KEPT_POWERS else 1 << (n - 1).bit_length(), base, U64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if n <= _KEPT_POWERS:
        _POWERS[:] = both
    return both[0][:n], both[1][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def row_slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def split_words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> Words:
    """Words of the rows between the offsets; byte places count from the first row's start."""
    base, rows = offsets[0], len(offsets) - 1
    part, at = data[base : offsets[-1]], offsets - base
    n = len(part)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U64), np.zeros(rows + 1, np.int64))
    inside = table[0][part]
    heads = at[:-1][at[:-1] < n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(table[1][part] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, row, hashes, first)


def hash_word(word: str, table: tuple[np.ndarray, np.ndarray]) -> np.uint64:
    """The hash that split_words gives this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return split_words(raw, np.array([0, len(raw)]), table).hash[0]


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the result is n - 1 shorter."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = mix(out + hashes[i : i + m]) + U64(i + 1)
    return out
