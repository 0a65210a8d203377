"""Secret scan: shapes of known secrets, and a battery of randomness tests for other long tokens.

A token is a run of MIN_LENGTH or more of [A-Za-z0-9+/_-]. Its encoding is inferred from its
characters (hex, base32, base62, base64), which gives an alphabet; mere numbers (of cards, accounts,
articles) are as random and no secrets, and are not looked at. Chi-squared uniformity over the
alphabet, the runs test about the middle and serial correlation each give a p-value of "uniformly
random"; a token that one of them rejects (Bonferroni, at ALPHA) is not random.

Not being rejected says little about short tokens, so a second p-value is that of "ordinary text":
exp(-r), r being the log-likelihood ratio of the uniform alphabet against character frequencies counted over
all texts (at most exp(-r) of ordinary tokens reach r, by Markov's inequality). Tokens are held
against Benjamini and Hochberg's bound in their band of lengths, over the whole corpus, so the share of false finds
is controlled for short and long tokens alike. Counts have a fixed size: 256 frequencies, bands x bins of p-values.

Defined results: null and empty texts have no spans; repeated rows count and are scanned each; without
any token nothing is added; other columns stay, a column with the name of a result is replaced. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import set_apart
from tessera.llm.words import bytes_of, row_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
MIN_LENGTH = 16
ALPHA = 0.003
FALSE_SHARE = 0.01
#: Lower ends of the bands of lengths.
BANDS = (16, 20, 24, 32, 48)
#: p-values are rounded up to powers of 10**-0.1, 10**-30 at least.
BINS = 300
ENCODINGS: list[tuple[str, re.Pattern, str]] = [
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
IS_TOKEN = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") for b in range(256)])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def encoding(token: str) -> tuple[str, np.ndarray, int] | None:
    """Name, values and size of the smallest alphabet that the token fits; None for numbers."""
    if token.isdigit():
        return None
    for name, pattern, alphabet in ENCODINGS:
        if pattern.fullmatch(token):
            token = token.lower() if name == "hex" else token
            return name, np.array([alphabet.index(c) for c in token]), len(alphabet)
    return None


def p_random(values: np.ndarray, size: int) -> float:
    """p-value of uniform randomness: the least of three tests', times three."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    mean, spread = size - 1, math.sqrt(2 * (size - 1) * (n - 1) / n)
    # Wilson and Hilferty's cube root, about the exact mean and spread of few draws
    v = 2 * mean * mean / spread**2
    cube = (chi / mean) ** (1 / 3)
    p = [upper_tail((cube - (1 - 2 / (9 * v))) / math.sqrt(2 / (9 * v)))]
    high = values >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mu = 2 * a * b / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p.append(2 * upper_tail(abs(runs - mu) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = values - values.mean()
    total = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    p.append(2 * upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p))


def log_p_ordinary(token: str, size: int, log_frequency: np.ndarray) -> float:
    """Log of a bound of the p-value of ordinary text."""
    raw = np.frombuffer(token.encode(), np.uint8)
    return min(0.0, float(log_frequency[raw].sum()) + len(raw) * math.log(size))


def band(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def bin_of(log_p: float) -> int:
    """Bin of a p-value: p is at most 10 ** (-bin / 10)."""
    return min(BINS, int(-log_p / math.log(10) * 10))


def _with_long_runs(texts: pa.Array) -> np.ndarray:
    """Which rows hold a token."""
    data, offsets = bytes_of(texts)
    out = np.zeros(len(texts), bool)
    for a, b in row_slices(offsets):
        part = IS_TOKEN[data[offsets[a] : offsets[b]]]
        edges = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8)))
        starts = edges[::2][edges[1::2] - edges[::2] >= MIN_LENGTH]  # may run across rows: too many rows is no harm
        ends = edges[1::2][edges[1::2] - edges[::2] >= MIN_LENGTH] - 1
        for at in (starts, ends):
            out[a + np.searchsorted(offsets[a : b + 1] - offsets[a], at, "right") - 1] = True
        for s, e in zip(starts, ends, strict=True):
            low, high = np.searchsorted(offsets[a : b + 1] - offsets[a], [s, e], "right") - 1
            out[a + low : a + high + 1] = True
    return out


def tokens(text: str, log_frequency: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
    """(start, end, p_random, log_p_ordinary) of each token."""
    for m in TOKEN.finditer(text):
        if m.end() - m.start() >= MIN_LENGTH and (known := encoding(m[0])):
            _, values, size = known
            yield m.start(), m.end(), p_random(values, size), log_p_ordinary(m[0], size, log_frequency)


def base_spans(text: str, long_run: bool) -> list[tuple[str, int, int]]:
    """Spans of the known shapes, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if long_run:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def frequencies(texts: DataFrame) -> np.ndarray:
    """Log frequencies of the characters of runs of token characters, over all texts, with one added to each count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            total += np.bincount(data[offsets[0] : offsets[-1]], minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    counts = np.ones(256)
    for r in texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] += r["n"]
    counts[~IS_TOKEN] = 0
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum())


def bounds(texts: DataFrame, log_frequency: np.ndarray, share: float = FALSE_SHARE) -> list[int]:
    """For each band of lengths the least bin that Benjamini and Hochberg's procedure accepts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(BANDS), BINS + 1), np.int64)
        for batch in batches:
            column = batch.column(0)
            for k in np.flatnonzero(_with_long_runs(column)).tolist():
                for start, end, _, log_p in tokens(column[k].as_py() or "", log_frequency):
                    total[band(end - start), bin_of(log_p)] += 1
        b, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(at), pa.array(total[b, at])], ["band", "bin", "n"])

    found = texts.mapInArrow(count, "band long, bin long, n long").groupBy("band", "bin").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(BANDS), BINS + 1), np.int64)
    for r in found:
        table[r.band, r.bin] = r.n
    return benjamini_hochberg(table, share)


def benjamini_hochberg(table: np.ndarray, share: float) -> list[int]:
    out = []
    for counts in table:
        below = np.cumsum(counts[::-1])[::-1]  # tokens with at most this bin's p-value
        ok = np.flatnonzero((below > 0) & (10.0 ** (-np.arange(BINS + 1) / 10) * counts.sum() <= share * below))
        out.append(int(ok[0]) if len(ok) else BINS + 1)
    return out


def scan(docs: DataFrame, text_col: str = "text", share: float = FALSE_SHARE, alpha: float = ALPHA) -> DataFrame:
    """The documents with base and found: arrays of (kind, start, end), by start, then kind; found lie in no base span."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    log_frequency = frequencies(texts)
    least = bounds(texts, log_frequency, share)

    @F.arrow_udf("base array<struct<kind:string,start:long,end:long>>, found array<struct<kind:string,start:long,end:long>>")
    def scanned(batch: pa.Array) -> pa.Array:
        base, found = [], []
        long_runs = _with_long_runs(batch)
        for k, x in enumerate(batch):
            text = x.as_py() or ""
            own = base_spans(text, bool(long_runs[k]))
            more = []
            if long_runs[k]:
                at, reach = 0, 0  # base spans and tokens both come by start: the furthest end so far decides
                for start, end, random, log_p in tokens(text, log_frequency):
                    while at < len(own) and own[at][1] <= start:
                        reach, at = max(reach, own[at][2]), at + 1
                    if end > reach and random >= alpha and bin_of(log_p) >= least[band(end - start)]:
                        more.append(("random", start, end))
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
            found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in more])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(SPAN)), pa.array(found, pa.list_(SPAN))], ["base", "found"])

    apart, kept, text = set_apart(docs, text_col, ("base", "found"))
    return apart.withColumn("scan", scanned(text)).select(*kept, "scan.base", "scan.found")
