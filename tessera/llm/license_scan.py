"""License scan by ordered signature rules behind a keyword prefilter.

Hashes of all words of a batch are compared with the rules' keywords at once; only a text with a
keyword is looked at, and only by the rules that its keywords allow. Detections are taken in order of
priority, then length, then place; one whose interval lies within that of a detection taken before is
suppressed. Places of the base phrases are counted beside and never suppressed.

Defined results: null and empty texts have no words and no labels; overlapping places of base phrases
count each; repeated rows are scanned each; other columns stay, a column with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import license_rules
from tessera.llm.tables import set_apart
from tessera.llm.words import ALNUM_SPLIT, bytes_of, hash_word, row_slices, split_words

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())])
RESULT = "n_words long, base array<struct<label:string,start:long,end:long,confidence:double>>, found array<struct<label:string,start:long,end:long,confidence:double>>"


class Intervals:
    """Intervals of which none contains another; one within any of them isn't taken in."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []  # ascending, as the starts are

    def add(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        if k and self.ends[k - 1] >= end:
            return False
        # those that lie within the new one say nothing more
        low = k - 1 if k and self.starts[k - 1] == start else k
        high = bisect_right(self.ends, end)
        self.starts[low : max(low, high)], self.ends[low : max(low, high)] = [start], [end]
        return True


class Scanner:
    def __init__(self):
        self.rules = license_rules.rules()
        self.base = [(label, word, re.compile(f"(?<= ){phrase}(?= )"), len(phrase.split())) for label, word, phrase in license_rules.BASE]
        words = sorted({w for r in self.rules for w in r.keywords} | {b[1] for b in self.base})
        hashes = np.array([hash_word(w, ALNUM_SPLIT) for w in words])
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [words[i] for i in order]

    def keywords(self, words) -> dict[int, set[str]]:
        """Keywords of the rows that have any."""
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        out: dict[int, set[str]] = {}
        hits = np.flatnonzero(self.hashes[at] == words.hash)
        for row, k in zip(words.row[hits].tolist(), at[hits].tolist(), strict=True):
            out.setdefault(row, set()).add(self.words[k])
        return out

    def scan(self, text: str, keywords: set[str]) -> tuple[list[tuple], list[tuple]]:
        """(base, found): lists of (label, first word, word after the last, confidence)."""
        words = WORD.findall(text.translate(LOWER))
        line = " " + " ".join(words) + " "
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])
        word_at = lambda c: int(np.searchsorted(starts, c))
        base = []
        for label, word, pattern, n in self.base:
            if word in keywords:
                for m in pattern.finditer(line):
                    w = word_at(m.start())
                    base.append((label, w, w + n, 1.0))
        hits = []
        for rule in self.rules:
            if rule.keywords & keywords:
                hits += [(rule.priority, m.start() - m.end(), m.start(), rule.label, word_at(m.start()), word_at(m.end() + 1), rule.confidence) for m in rule.pattern.finditer(line)]
        found: list[tuple] = []
        taken = Intervals()
        for _, _, _, label, a, b, confidence in sorted(hits):
            if taken.add(a, b):
                found.append((label, a, b, confidence))
        return sorted(base, key=lambda x: x[1]), sorted(found, key=lambda x: x[1])


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def _scanned(texts: pa.Array) -> pa.Array:
    own = scanner()
    data, offsets = bytes_of(texts)
    n_words: list[int] = []
    base: list[list] = []
    found: list[list] = []
    for a, b in row_slices(offsets):
        words = split_words(data, offsets[a : b + 1], ALNUM_SPLIT)
        n_words += np.diff(words.first).tolist()
        keywords = own.keywords(words)
        for k in range(b - a):
            got = own.scan(texts[a + k].as_py(), keywords[k]) if k in keywords else ([], [])
            base.append([dict(zip(("label", "start", "end", "confidence"), x, strict=True)) for x in got[0]])
            found.append([dict(zip(("label", "start", "end", "confidence"), x, strict=True)) for x in got[1]])
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(base, pa.list_(SPAN)), pa.array(found, pa.list_(SPAN))], ["n_words", "base", "found"])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, base and found (arrays of label, start, end in words, confidence) and score.

    score: 1 minus the product of what each detection, base ones included, leaves open.
    """

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _scanned(texts)

    apart, kept, text = set_apart(docs, text_col, ("n_words", "base", "found", "score"))
    left = F.aggregate(F.concat("scan.base", "scan.found"), F.lit(1.0), lambda x, d: x * (1.0 - d["confidence"]))
    return apart.withColumn("scan", scanned(text)).select(*kept, "scan.n_words", "scan.base", "scan.found", (F.lit(1.0) - left).alias("score"))
