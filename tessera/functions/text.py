"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāēīōūčšžłńśźżęąőűğş"
FOLDED = "aaaaaaceeeeiiiinoooooouuuuyyaeioucszlnszzeaougs"
PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("&", " and "))


def fold(text: Column) -> Column:
    """Lower case, Latin marks dropped."""
    out = F.translate(F.lower(text), MARKED, FOLDED)
    for a, b in PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize(text: Column) -> Column:
    """Folded, everything but a-z and 0-9 to single spaces, one leading article dropped."""
    plain = F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^(?:the|an|a) (?=.)", "")


def slugify(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit("-"))


def text_hash(text: Column) -> Column:
    """Equal for texts that differ only in case, spacing and punctuation."""
    return F.sha1(F.regexp_replace(F.lower(text), r"(?U)\W+", ""))


def base_name(name: Column) -> Column:
    """Name without parentheses, normalised."""
    return normalize(F.regexp_replace(name, r"\s*\([^)]*\)", ""))


def is_lookalike(a: Column, b: Column) -> Column:
    """At least 4 letters, neither within the other, not differing in digits only, one edit apart (two from 8 letters on)."""
    digits = lambda x: F.regexp_replace(x, r"\d", "")
    near = F.when(F.greatest(F.length(a), F.length(b)) < 8, F.levenshtein(a, b, 1)).otherwise(F.levenshtein(a, b, 2))
    return (F.length(a) >= 4) & (F.length(b) >= 4) & ~a.contains(b) & ~b.contains(a) & (digits(a) != digits(b)) & (near > 0)


def difficulty_band(difficulty: Column) -> Column:
    return F.when(difficulty.isNull() | (difficulty == 0), "unrated").when(difficulty == 1, "middle_school").when(difficulty <= 5, "high_school").when(difficulty <= 9, "college").otherwise("open")


def negated(text: Column, label: Column) -> Column:
    """Whether a text says not, an article or none, and the label (plain words), whatever the case."""
    return F.rlike(F.lower(text), F.concat(F.lit(r"\bnot\s+(?:an?\s+|the\s+)?"), F.lower(label), F.lit(r"\b")))


def usable_alias(alias: Column, stop_words: tuple[str, ...]) -> Column:
    """Three letters or digits at least, not a number, no stop word."""
    bare = F.regexp_replace(F.lower(alias), "[^a-z0-9]", "")
    return (F.length(bare) >= 3) & ~F.rlike(bare, F.lit("^[0-9]+$")) & ~F.lower(F.trim(alias)).isin(*stop_words)


def proper_name(alias: Column) -> Column:
    """All words of three letters or more begin with a capital, and there is one."""
    long = F.regexp_extract_all(alias, F.lit("[A-Za-z]{3,}"), F.lit(0))
    return (F.size(long) > 0) & F.forall(long, lambda w: F.rlike(w, F.lit("^[A-Z]")))


def position_in(longer: Column, shorter: Column) -> Column:
    """Place from 0 at which an array of words stands in another one first; -1 where it doesn't, 0 for no words."""
    n = F.size(shorter)
    places = F.when(F.size(longer) >= n, F.sequence(F.lit(0), F.size(longer) - n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda k: F.slice(longer, k + 1, n) == shorter), F.lit(0)), F.lit(-1))
