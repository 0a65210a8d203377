"""Document fingerprints by winnowing over code points.

A rolling polynomial hash of each K consecutive code points, of each WINDOW of hashes the smallest
with the rightmost place among equals; hash and place are kept. Every shared run of K + WINDOW - 1
code points (15) gives two texts a common hash. A text shorter than K has one hash, of the whole text.

Neighbours in id order meet without a global sort in one task: rows are cut into ranges by id and the text's first
code points, at places that Spark's range partitioner samples (any cuts give the same result), so that rows of one id or
of null ids are cut, too. Each range is a task of its own; it also receives the first text of the next one that has rows,
and rows are sorted within their range. The driver holds a short key for each range, MOST_RANGES at most.

Defined results: null and empty texts have the fingerprint of the empty text; equal texts have equal
fingerprints; rows with equal ids follow one another in order of text, null ids come first; an only
row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import winnow
from tessera.llm.words import mix, powers

K, WINDOW = 8, 8
#: Ranges, and code points of a text that cut rows of equal ids.
MOST_RANGES, TIE = 100_000, 24
U64 = np.uint64


def grams(points: np.ndarray, k: int = K) -> np.ndarray:
    """Rolling hashes of k consecutive code points; one hash for a shorter text."""
    n = len(points)
    if n < k:
        k = n
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + U64(k))


def fingerprint(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (upper 32 bits) and places of the kept grams."""
    g = grams(points, k)
    at = winnow.kept(g, window)
    return (g[at] >> U64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def printed(hashes: np.ndarray, places: np.ndarray) -> str:
    """Hash and distance from the place before, in hexadecimal, comma-joined."""
    return ",".join(f"{h:08x}.{d:x}" for h, d in zip(hashes.tolist(), np.diff(places, prepend=0).tolist(), strict=True))


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of a text column as hashes and places, for joins on hashes."""

    @F.arrow_udf("hashes array<long>, places array<int>")
    def printed_texts(texts: pa.Array) -> pa.Array:
        found = [fingerprint(points_of(x.as_py())) for x in texts]
        hashes, places = pa.array([f[0].astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([hashes, places], ["hashes", "places"])

    return printed_texts(text)


def with_next(docs: DataFrame, rows_per_range: int = 4000) -> DataFrame:
    """Rows of (doc_id, text) sorted within id ranges, and rows with ``halo`` that only serve as the next of a range's last."""
    spark = docs.sparkSession
    ranges = max(1, min(MOST_RANGES, -(-docs.count() // rows_per_range)))
    order = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order")  # null before all others
    tie = F.substring(F.coalesce("text", F.lit("")), 1, TIE).alias("tie")
    least = F.min(F.struct("order", "tie"))
    parts = docs.select(order, tie).repartitionByRange(ranges, "order", "tie").groupBy(F.spark_partition_id()).agg(least.alias("cut"))
    cuts = sorted((r["cut"]["order"], r["cut"]["tie"]) for r in parts.collect())
    ids = np.array([c[0] for c in cuts], np.int64)

    @F.arrow_udf("int")
    def range_of(orders: pa.Array, ties: pa.Array) -> pa.Array:
        at = orders.to_numpy()
        low, high = np.searchsorted(ids, at), np.searchsorted(ids, at, "right")
        for k in np.flatnonzero(high > low).tolist():  # ids of cuts: the text's beginning decides
            high[k] = bisect_right(cuts, (int(at[k]), ties[k].as_py()), int(low[k]), int(high[k]))
        return pa.array(np.maximum(high - 1, 0).astype(np.int32))

    placed = docs.select("doc_id", "text", range_of(order, tie).alias("range"), F.lit(False).alias("halo"), order, tie)
    firsts = placed.groupBy("range").agg(least.alias("first")).orderBy("range").collect()  # one row per range
    # a range's first text also goes to the range before; the very first one to the last range
    ends = spark.createDataFrame([(r["first"]["order"], r["first"]["tie"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)], "order long, tie string, to int")
    same = docs.select("text", order, tie).join(F.broadcast(ends), ["order", "tie"])
    halo = same.groupBy("to").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(True).alias("halo"))
    both = placed.drop("order", "tie").unionByName(halo)
    return both.repartitionById(max(1, len(cuts)), F.col("range")).sortWithinPartitions("range", "halo", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, next text) of every row that isn't a halo; rows come as with_next sorts them."""
    last = None
    for batch in batches:
        for i, text, at, halo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "halo")), strict=True):
            if last is not None and last[2] == at and not last[3]:
                yield last[0], last[1], text or ""
            last = (i, text or "", at, halo)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, batch: int = 500) -> DataFrame:
    """Per row: id, text length, the text whose last quarter is the next row's beginning, printed fingerprints of both, likenesses."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        out: list[tuple] = []
        known: tuple = ("", fingerprint(points_of(""), k, window))
        for i, text, following in _pairs(batches):
            own = known[1] if known[0] == text else fingerprint(points_of(text), k, window)
            known = (following, fingerprint(points_of(following), k, window))
            q = len(text) // 4
            edited = text[: len(text) - q] + following[:q]
            new = fingerprint(points_of(edited), k, window)
            out.append((i, len(text), edited, printed(*own), printed(*new), likeness(own[0], new[0]), likeness(own[0], known[1][0])))
            if len(out) == batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(rows).mapInArrow(compared, schema)
