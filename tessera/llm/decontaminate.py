"""Benchmark decontamination by winnowing.

Item and document words give hashes of K consecutive words; of each WINDOW of those the smallest is
kept, so two texts that share K + WINDOW - 1 = 10 consecutive words share a kept gram. Kept grams of
documents are looked up among those of the items, and each hit is extended both ways to the windows of 10 words that hold it;
those that an item has count, and together they are all of a shared passage. Items of fewer than 10 words are looked up whole, per length.

A benchmark of at most BLOCK_BYTES of text is collected and broadcast as an index, and documents aren't
shuffled. A larger one is joined with the distinct texts by their kept grams, whatever its size.

Defined results: null and empty texts have no words, no hits and no items; an item without words or
without id never occurs; equal item ids count once; an empty benchmark marks nothing; repeated rows
are marked each. Other columns stay; a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import winnow
from tessera.llm.tables import set_apart, stored
from tessera.llm.words import ALNUM_SPLIT, U64, bytes_of, ngram_hashes, row_slices, split_words

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: Bytes of benchmark text that are collected and broadcast at most.
BLOCK_BYTES = 32 << 20
#: Tasks over which the documents of one gram are dealt when grams are joined.
SALTS = 8
SPAN_KIND = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = "n_words long, items array<long>, spans array<struct<start:long,end:long>>"


class Lookup:
    """Sorted distinct hashes, and for each the items that have it."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])][: len(hashes)]
        hashes, self.items = hashes[fresh], items[fresh]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        self.hashes, self.ends = hashes[starts], np.r_[starts, len(hashes)]

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted hash stands; -1 where it is missing."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def items_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the places, item) for all items at the places."""
        n = self.ends[places + 1] - self.ends[places]
        which = np.repeat(np.arange(len(places)), n)
        return which, self.items[np.arange(n.sum()) + np.repeat(self.ends[places] - (np.cumsum(n) - n), n)]


class ItemIndex:
    """Kept grams of the long items, their windows, and the short items as windows of their own length."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = bytes_of(pa.array(texts, pa.string()))
        words = split_words(data, offsets, ALNUM_SPLIT)
        self.ids = np.array(ids, np.int64)
        grams, found = [np.zeros(0, U64)], {}
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist(), strict=False)):
            n = min(b - a, SPAN)
            if n == SPAN:
                g = ngram_hashes(words.hash[a:b], K)
                grams.append(np.unique(g[winnow.kept(g, WINDOW)]))
            if n:
                windows = ngram_hashes(words.hash[a:b], n)
                found.setdefault(n, []).append((windows, np.full(len(windows), i)))
        self.grams = np.unique(np.concatenate(grams))
        self.windows = {n: Lookup(*(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in found.items()}


def _hits(words, index: ItemIndex) -> np.ndarray:
    """First words of the windows of SPAN words around kept grams that items have kept, too."""
    grams = ngram_hashes(words.hash, K)
    if not len(grams) or not len(index.grams):
        return np.zeros(0, np.int64)
    inner = np.flatnonzero(words.row[: len(grams)] == words.row[K - 1 :])  # not across two rows
    first = np.r_[0, np.cumsum(np.maximum(0, np.diff(words.first) - K + 1))]
    at = inner[winnow.kept_of_many(grams[inner], first, WINDOW)]
    met = at[index.grams[np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)] == grams[at]]
    starts = np.unique((met[:, None] - np.arange(WINDOW)[None, :]).ravel())
    row = words.row[np.maximum(starts, 0)]
    return starts[(starts >= 0) & (starts + SPAN <= words.first[row + 1])]


def occurrences(words, index: ItemIndex) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(first words, length, rows, items) of the windows of each length that items have: places, and distinct pairs of row and item.

    A hit of kept grams is extended to all windows that hold the gram; what is longer than a window is the union of its windows. So work
    and memory grow with the words and with the pairs of row and item, however often words repeat.
    """
    for n, lookup in index.windows.items():
        if n == SPAN:
            starts = _hits(words, index)
        else:
            starts = np.arange(max(0, len(words.hash) - n + 1))
            starts = starts[words.row[starts] == words.row[starts + n - 1]] if len(starts) else starts
        if not len(starts):
            continue
        places = lookup.places(ngram_hashes(words.hash, n)[starts])
        starts, places = starts[places >= 0], places[places >= 0]
        pairs = np.unique(np.stack([words.row[starts], places], 1), axis=0)  # a window that repeats in a row counts once
        which, items = lookup.items_at(pairs[:, 1])
        pairs = np.unique(np.stack([pairs[which, 0], items], 1), axis=0)
        yield starts, n, pairs[:, 0], pairs[:, 1]


def _marked(texts: pa.Array, index: ItemIndex) -> pa.Array:
    data, offsets = bytes_of(texts)
    n_words, items, spans = [], [], []
    for a, b in row_slices(offsets):
        words = split_words(data, offsets[a : b + 1], ALNUM_SPLIT)
        n_words += np.diff(words.first).tolist()
        own: list[set[int]] = [set() for _ in range(b - a)]
        inside: list[set[tuple[int, int]]] = [set() for _ in range(b - a)]
        for starts, n, rows, found in occurrences(words, index):
            for row, i in zip(rows.tolist(), index.ids[found].tolist(), strict=True):
                own[row].add(i)
            # windows that overlap or touch within a row are one span
            cut = np.flatnonzero((np.diff(starts) > n) | (np.diff(words.row[starts]) != 0)) + 1
            low, last = starts[np.r_[0, cut]] if len(starts) else starts, starts[np.r_[cut, len(starts)] - 1] if len(starts) else starts
            row = words.row[low]
            for r, s, e in zip(row.tolist(), (low - words.first[row]).tolist(), (last + n - words.first[row]).tolist(), strict=True):
                inside[r].add((s, e))
        items += [sorted(x) for x in own]
        spans += [[{"start": s, "end": e} for s, e in _united(x)] for x in inside]
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(SPAN_KIND))], ["n_words", "items", "spans"])


def _united(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _indexed(texts: DataFrame, index: ItemIndex) -> DataFrame:
    """The rows with what the index marks in each text; the index is broadcast."""
    sent = texts.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(RESULT)
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            yield _marked(part, sent.value)

    return texts.withColumn("marked", marked("text"))


def _kept_grams(texts: DataFrame, key: str, lengths: list[int], whole: bool) -> DataFrame:
    """(key, gram, salt): the kept grams of texts of SPAN words or more and grams of the given smaller lengths.

    Of items (``whole``) a text of fewer words gives the one gram of all its words.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for a, b in row_slices(offsets):
                words = split_words(data, offsets[a : b + 1], ALNUM_SPLIT)
                rows, grams = [], []
                for k, (low, high) in enumerate(zip(words.first.tolist(), words.first[1:].tolist(), strict=False)):
                    n, found = high - low, []
                    if n >= SPAN:
                        g = ngram_hashes(words.hash[low:high], K)
                        found.append(g[winnow.kept(g, WINDOW)])
                    for m in lengths:
                        if n == m or n > m and not whole:
                            found.append(ngram_hashes(words.hash[low:high], m) ^ U64(m))
                    if found:
                        grams.append(np.unique(np.concatenate(found)).view(np.int64))
                        rows.append(np.full(len(grams[-1]), a + k))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(grams))], [key, "gram"])

    grams = texts.select(key, "text").mapInArrow(emit, f"{key} string, gram long")
    if whole:  # each item gram meets the documents' in SALTS tasks, as one gram may be in a third of all documents
        return grams.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    return grams.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, items, spans) of the distinct texts (digest, text) in which an item occurs, by a join on fingerprints.

    Candidate pairs are verified word by word, each item's index being made for its pair.
    """
    items = stored(items.select(F.sha2("text", 256).alias("item"), "item_id", "text"), "items")
    once = items.select("item", "text").dropDuplicates(["item"])

    def n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(*bytes_of(batch.column("text")), ALNUM_SPLIT)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.diff(words.first)).astype(np.int64))], ["n"])

    lengths = sorted(r.n for r in once.select("text").mapInArrow(n_words, "n long").where(f"n between 1 and {SPAN - 1}").distinct().collect())
    pairs = _kept_grams(texts, "digest", lengths, False).join(_kept_grams(once, "item", lengths, True), ["gram", "salt"]).select("digest", "item").distinct()
    # an item may be in a third of all texts: it meets them in SALTS tasks
    every = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    full = stored(salted, "pairs").join(texts, "digest").join(once.select("item", F.col("text").alias("sought"), every.alias("salt")), ["item", "salt"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indexes: dict[str, ItemIndex] = {}
            found = []
            for k, (item, sought) in enumerate(zip(batch.column("item").to_pylist(), batch.column("sought"), strict=True)):
                if item not in indexes:
                    indexes[item] = ItemIndex([0], [sought.as_py()])
                found.append(_marked(batch.column("text").slice(k, 1), indexes[item]).field("spans")[0].as_py())
            some = pa.array(np.flatnonzero([bool(f) for f in found]))
            spans = pa.array([f for f in found if f], pa.list_(SPAN_KIND))
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(some), batch.column("item").take(some), spans], ["digest", "item", "spans"])

    hits = full.select("digest", "item", "text", "sought").mapInArrow(verified, "digest string, item string, spans array<struct<start:long,end:long>>")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    named = hits.join(items.select("item", "item_id", every.alias("salt")), ["item", "salt"])
    return named.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))


def _union(spans: str) -> Column:
    @F.arrow_udf("array<struct<start:long,end:long>>")
    def united(column: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "end": e} for s, e in _united({(x["start"], x["end"]) for x in row or []})] for row in column.to_pylist()], pa.list_(SPAN_KIND))

    return united(spans)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, items (array of item ids) and spans (word ranges, [start, end), disjoint)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    apart, kept, text = set_apart(docs, text_col, ("n_words", "n_hit", "items", "spans"))
    apart = apart.withColumn("text", text)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= block_bytes:
        rows = items.collect()
        found = _indexed(apart, ItemIndex([r.item_id for r in rows], [r.text for r in rows]))
        n_words, own, spans = (F.col(f"marked.{c}") for c in ("n_words", "items", "spans"))
    else:
        found = _indexed(apart, ItemIndex([], [])).withColumn("digest", F.sha2("text", 256))
        texts = stored(apart.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"]), "texts")
        found = found.join(_joined(texts, items), "digest", "left")
        n_words, own, spans = F.col("marked.n_words"), F.coalesce("items", F.array().cast("array<long>")), _union("spans")
    made = found.select(*kept, n_words.alias("n_words"), own.alias("items"), spans.alias("spans"))
    return made.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))
