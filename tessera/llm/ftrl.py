"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, word pairs and pairs with one word between, hashed to 2**18
coordinates. Each coordinate has its own learning rate, and an L1 penalty keeps most weights at zero.
Learners run side by side over shards of SHARD_ROWS of a bounded sample of labelled rows (MAX_ROWS,
those with the smallest hash of their id); the weights are the mean of the shards'. What is broadcast has a fixed
size: 2**18 weights. Every text is scored whole.

Defined results: null and empty texts have no features and get the score of the bias; rows without a
label (or with a null one) aren't learned from; an id labelled more than once counts each time; with
no labelled row at all every score is 0.5; repeated rows are scored each; other columns stay, a column with the name of a
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM_SPLIT, U64, Words, bytes_of, mix, row_slices, split_words

BITS = 18
MAX_ROWS = 40_000
SHARD_ROWS = 10_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of each distinct feature of each row."""
    h, rows = words.hash, words.row
    parts = [(rows, h)]
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xCBF29CE484222325)):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            parts.append((rows[gap:][same], mix(mix(h[:-gap][same] + U64(salt)) + h[gap:][same])))
    row = np.concatenate([p[0] for p in parts])
    at = (np.concatenate([p[1] for p in parts]) >> U64(64 - BITS)).astype(np.int64)
    both = np.unique((row << BITS) | at)
    return both >> BITS, both & ((1 << BITS) - 1)


class Learner:
    """FTRL-proximal: weights follow from sums of gradients (z) and of their squares (n); the last coordinate is the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, np.ndarray]] = []  # order, label, features
    for batch in batches:
        data, offsets = bytes_of(batch.column("text"))
        labels, orders = batch.column("label").to_pylist(), batch.column("order").to_pylist()
        for a, b in row_slices(offsets):
            row, at = features(split_words(data, offsets[a : b + 1], ALNUM_SPLIT))
            ends, at = np.searchsorted(row, np.arange(b - a + 1)), at.astype(np.int32)
            rows += [(orders[a + k], labels[a + k], at[ends[k] : ends[k + 1]]) for k in range(b - a)]
    if rows:
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))  # shuffles bring rows in any order
        learner = Learner()
        for _ in range(EPOCHS):
            for _, label, at in rows:
                learner.learn(np.append(at, 1 << BITS), label)
        w = learner.weights()
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["at", "w"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """Weights, bias last, from documents (doc_id, text) and labels (doc_id, label_col: 0 or 1)."""
    order = F.xxhash64("doc_id")
    sample = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("label")).dropna()
    sample = sample.withColumn("order", order).orderBy("order", "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "order", F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, -(-sample.count() // shard_rows))
    shard = F.pmod(F.xxhash64("order"), F.lit(shards))
    learned = rows.repartition(shards, shard).mapInArrow(_learned, "at long, w double")
    found = learned.groupBy("at").agg(F.sum("w").alias("w")).collect()  # at most 2**18 + 1 rows
    out = np.zeros((1 << BITS) + 1)
    for r in found:
        out[r["at"]] = r["w"] / shards
    return out


def score_column(docs: DataFrame, text: Column, weights: np.ndarray) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w = sent.value
        data, offsets = bytes_of(texts)
        sums = np.zeros(len(texts))
        for a, b in row_slices(offsets):
            row, at = features(split_words(data, offsets[a : b + 1], ALNUM_SPLIT))
            sums[a:b] = np.bincount(row, w[at], b - a)
        return pa.array(1 / (1 + np.exp(-np.clip(sums + w[-1], -35, 35))))

    return scored(text)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from 0.5 on)."""
    out = docs.withColumn("score", score_column(docs, F.col(f"`{text_col}`").cast("string"), weights))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: Column) -> Column:
    """Every fifth id by crc32 of its text; never learned from. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(True))
