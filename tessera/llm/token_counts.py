"""Token counts by byte-pair merging, without making token ids.

A word's count is its number of initial symbols minus the merges that the heap performs. Each task
keeps a table of the words it has counted, of TABLE_BYTES and the words of one text at most, so a word
is merged once per worker, not once per use; words longer than LONG_WORD aren't kept. There is no shuffle.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each; other columns
of the input are kept by ``count_tokens`` unless they have the name of a result, which wins.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe

#: Bytes of the words kept per worker; at this size the table starts anew.
TABLE_BYTES = 32 << 20
#: Bytes that an entry takes beside its characters.
ENTRY_BYTES = 160
#: Code points up to which a word is kept.
LONG_WORD = 256


# Letters and numbers that Unicode 16 has and Python's 15.1 tables lack, and the lower
# case of its new capitals. The tokenizer library goes by Unicode 16, the regex module by a later one.
NEW_IN_16 = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d40-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    "\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U000116d0-\U000116e3"
    "\U00011bc0-\U00011be0\U00011bf0-\U00011bf9\U00013460-\U000143fa\U00016100-\U0001611d\U00016130-\U00016139"
    "\U00016d40-\U00016d6c\U00016d70-\U00016d79\U00018cff\U0001ccf0-\U0001ccf9\U0001e5d0-\U0001e5ed\U0001e5f0-\U0001e5fa"
)
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}}


@functools.cache
def _later_letters() -> str:
    """A character class of code points that the regex module takes for letters or numbers and Unicode 16 doesn't have."""
    kind, known = regex.compile(r"[\p{L}\p{N}]"), regex.compile(f"[{NEW_IN_16}]")
    found = [c for c in range(0x250, 0x40000) if unicodedata.category(chr(c)) == "Cn" and kind.match(chr(c)) and not known.match(chr(c))]
    return _ranges(found)


def _ranges(points: list[int]) -> str:
    starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies give each byte: itself where printable, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts the tokens of texts under a tokenizer file of lower-cased word BPE with a word-end suffix."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.new = regex.compile(f"[{_later_letters()}{NEW_IN_16}]")
        self.careful_words = regex.compile(self.words.pattern.replace(r"[\p{L}]", f"[\\p{{L}}--[{_later_letters()}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{_later_letters()}]]").replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^[\\p{{White_Space}}\\p{{L}}\\p{{N}}]--[{_later_letters()}]]"), regex.V1)
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}
        self.bytes = 0

    def of_word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        n = len(symbols)
        return n - bpe.merge(symbols, self.ranks.get)

    def _of_plain(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # lower() would choose a final sigma by context
        if text.isascii() or not self.new.search(text):
            words = self.words.findall(text)
        else:
            words = self.careful_words.findall(text.translate(NEW_LOWER))
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if self.bytes > TABLE_BYTES:
            known.clear()
            self.bytes = 0
        for word in set(words):
            if word not in known:
                known[word] = self.of_word(word)
                self.bytes += ENTRY_BYTES + 4 * len(word)
        total = sum(map(known.__getitem__, words))
        for word in {w for w in words if len(w) > LONG_WORD}:
            del known[word]
            self.bytes -= ENTRY_BYTES + 4 * len(word)
        return total

    def count(self, text: str) -> int:
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._of_plain(text)
        return sum(map(self._of_plain, self.special.split(text))) + len(self.special.findall(text))


@functools.lru_cache(2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column under the tokenizer file at ``path`` (a path that executors can read)."""

    @F.arrow_udf(T.LongType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path).count
        for texts in batches:
            yield pa.array([count(x.as_py() or "") for x in texts], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(text, path)}).withColumn("over_limit", F.col("n_tokens") > limit)
