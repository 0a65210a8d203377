"""Importance resampling towards a target's distribution over hashed n-grams.

A text's UTF-8 bytes go through one table of 256 bytes that lower-cases A-Z and blanks what is no word byte; split gives
the words. A run's checksum goes on from the checksum of the run without its last word: crc32(" " + word, seed). Counters per task
give at most ``buckets`` rows each, summed by Spark; the driver holds two vectors of that size and sends one vector of gains
back to the tasks. A row's weight is the sum of its features' gains; noise from a hash of the id makes the draw of the highest
scores a draw without replacement. Ranks are places in order of score (``positions``), so nothing sorts in one task.

Defined results: null and empty texts have no features and weight 0; null ids hash as an empty text and, among equal scores, come
first; rows of one id are drawn apart, equal ones in any order; with no target or no documents all gains follow from the formula with zero counts;
an empty table gives no rows; other columns don't matter. A text is split in pieces of about a megabyte, runs of words go across pieces.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.positions import positions
from tessera.llm.tables import stored

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
PIECE = 1 << 20


def pieces(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes at a time; no word is cut."""
    raw = (text or "").encode().translate(TABLE)
    low = 0
    while low < len(raw):
        high = raw.find(b" ", low + size)
        high = len(raw) if high < 0 else high
        yield raw[low:high].split()
        low = high


def features(text: str | None, n: int, buckets: int) -> tuple[int, Counter]:
    """How many words a text has, and how often each bucket is met by runs of 1 to n words."""
    words, counts, open_runs = 0, Counter(), []
    for some in pieces(text):
        words += len(some)
        if n == 1:
            for word, times in Counter(some).items():
                counts[zlib.crc32(word) % buckets] += times
            continue
        for word in some:
            longer = b" " + word
            open_runs = [zlib.crc32(word), *[zlib.crc32(longer, seed) for seed in open_runs[: n - 1]]]
            counts.update(seed % buckets for seed in open_runs)
    return words, counts


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> list[int]:
    """How often each bucket is met in all texts of the only column."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(features(text.as_py(), n, buckets)[1])
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    out = [0] * buckets
    for r in texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of the ratio of smoothed shares, target by source, per bucket."""
    b, s, t = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source, target, strict=True)]


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256 of "seed:id"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gains: list[int], n: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_features, weight)."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weighed(texts: pa.Array) -> pa.Array:
        words, sizes, weights = [], [], []
        for text in texts:
            k, counts = features(text.as_py(), n, len(gains))
            words.append(k)
            sizes.append(counts.total())
            weights.append(sum(gains[b] * times for b, times in counts.items()))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (words, sizes, weights)], ["n_words", "n_features", "weight"])

    return docs.select("doc_id", weighed("text").alias("w")).select("doc_id", "w.*")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Drawn are floor(percent * N / 100) of the N rows that have at least min_words words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = target.select(F.col(f"`{target_col}`").cast("string").alias("text"))
    gains = gains_of(bucket_counts(rows.select("text"), n, buckets), bucket_counts(wanted, n, buckets))
    scored = stored(weigh(rows, gains, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    ordered = positions(fit.withColumn("falling", -F.col("score")), ["falling", "doc_id", "n_features", "weight"]).drop("falling")
    ranked = ordered.withColumn("rank", F.when(F.col("rows_before") < drawn, F.col("rows_before") + 1)).drop("rows_before")
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
