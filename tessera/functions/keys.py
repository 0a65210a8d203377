"""Keys of words and spellings: folded to ASCII, with places in the text; one Arrow pass each.

Compatibility forms are resolved and marks dropped by the Unicode tables, letters that have no decomposition by LETTERS.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition, and titles, articles and small words in names.
LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k"}
HONORIFICS = "general gen colonel col lieutenant lt captain capt major admiral commander sergeant dr doctor mr mrs ms sir president senator sen governor gov".split()
ARTICLES = ("the", "a", "an")
#: Endings that look like a plural's and are none.
NO_PLURAL = ("ss", "us", "is", "ics", "os")
SPELLING = "struct<key:array<string>,loose:array<string>,words:array<string>,flat:array<string>,owner:array<boolean>>"
TOKEN = "array<struct<key:string,start:int,end:int,capital:boolean>>"
_PIECE = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")


@functools.lru_cache(100_000)
def folded(text: str) -> str:
    """ASCII, lower case, everything but letters and digits as single blanks."""
    plain = "".join(LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", plain.lower()).split())


def singular(word: str) -> str:
    """A word without its plural's ending, by the common endings."""
    if len(word) < 4 or not word.endswith("s") or word.endswith(NO_PLURAL):
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-2] if word.endswith(("ches", "shes", "xes", "sses", "zes")) else word[:-1]


def tokenized(text: str) -> list[tuple[str, int, int, bool]]:
    """(key, start, end, capital) of each word, several of one place where its key has several words; & is 'and'."""
    out = []
    for m in re.finditer(r"\w+|&", text):
        capital = m[0][0].isupper()
        out += [(k, m.start(), m.end(), capital) for k in (["and"] if m[0] == "&" else folded(m[0]).split())]
    return out


def spelled(form: str) -> dict:
    """What is needed to compare a spelling.

    key: its folded words without 's, a leading article, a title before two words or more, and initials beside two words or more; lower-case
    words are singular. loose: the key with all words singular. words: the tokens; flat and owner: each token's first loose word, and whether 's follows.
    """
    pieces = _PIECE.findall(form)
    words, initials, tokens, flat, owner = [], [], [], [], []
    for i, p in enumerate(pieces):
        if not p[0].isalnum():
            continue
        bare = re.sub(r"['’]s$", "", p)
        initial = len(p) == 1 and p.isalpha() and pieces[i + 1 : i + 2] == ["."]
        parts = folded(bare).split()
        if parts and bare[0].islower():
            parts[-1] = singular(parts[-1])
        words += parts
        initials += [initial] * len(parts)
        tokens.append(p)
        flat.append(singular(parts[0]) if parts else "")
        owner.append(bare != p)
    while words and words[0] in ARTICLES:
        del words[0], initials[0]
    if len(words) >= 3 and words[0] in HONORIFICS:
        del words[0], initials[0]
    if initials.count(False) >= 2:
        words = [w for w, x in zip(words, initials, strict=True) if not x]
    return {"key": words, "loose": [singular(w) for w in words], "words": tokens, "flat": flat, "owner": owner}


def spelling(form: Column) -> Column:
    """SPELLING of each form; null for null."""

    @F.arrow_udf(SPELLING)
    def read(forms: pa.Array) -> pa.Array:
        words, flags = pa.list_(pa.string()), pa.list_(pa.bool_())
        kind = pa.struct([("key", words), ("loose", words), ("words", words), ("flat", words), ("owner", flags)])
        return pa.array([None if f is None else spelled(f) for f in forms.to_pylist()], kind)

    return read(form)


def token_column(text: Column) -> Column:
    """TOKEN of each text; null has none."""

    @F.arrow_udf(TOKEN)
    def read(texts: pa.Array) -> pa.Array:
        names = ("key", "start", "end", "capital")
        kind = pa.list_(pa.struct([("key", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("capital", pa.bool_())]))
        return pa.array([[dict(zip(names, t, strict=True)) for t in tokenized(x or "")] for x in texts.to_pylist()], kind)

    return read(text)
