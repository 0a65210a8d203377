"""Phrase dictionaries matched in texts, longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of dictionary text up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def find_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, owner) of every place of a phrase (phrase, owner) in the documents (doc_id, text).

    Only n-grams of lengths that the dictionary has are made; the dictionary is broadcast if its
    measured size allows, else joined by a shuffle.
    """
    known = phrases.select(tokens(F.col("phrase")).alias("t"), "owner").where("size(t) > 0")
    known = known.select(F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("key"), "owner")
    sizes = known.agg(F.collect_set("n_tokens").alias("n"), F.sum(F.length("key")).alias("bytes")).first()
    lengths = sorted(sizes["n"])
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.struct((i - 1).alias("start"), F.lit(n).alias("n_tokens"), F.array_join(F.slice("t", i, n), " ").alias("key")))

    none = F.array().cast("array<struct<start:int,n_tokens:int,key:string>>")
    made = [F.when(F.size("t") >= n, grams(n)).otherwise(none) for n in lengths]
    placed = rows.select("doc_id", F.explode(F.concat(*made) if made else none).alias("g")).select("doc_id", "g.*")
    side = F.broadcast(known) if (sizes["bytes"] or 0) <= BROADCAST_BYTES else known
    return placed.join(side, ["key", "n_tokens"]).select("doc_id", "start", "n_tokens", "owner")


def longest_first(found: DataFrame) -> DataFrame:
    """Per document the matches left to right, the longest at a place, skipping what lies in one taken before."""
    best = found.groupBy("doc_id", "start").agg(F.max_by(F.struct("n_tokens", "owner"), F.struct("n_tokens", -F.col("owner"))).alias("b")).select("doc_id", "start", "b.*")
    ordered = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "n_tokens", "owner"))).alias("m"))  # matches of one document
    kind = "struct<next:int,out:array<struct<start:int,n_tokens:int,owner:bigint>>>"
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,n_tokens:int,owner:bigint>>").alias("out")).cast(kind)
    step = lambda acc, m: F.when(m["start"] >= acc["next"], F.struct((m["start"] + m["n_tokens"]).alias("next"), F.concat(acc["out"], F.array(m)).alias("out")).cast(kind)).otherwise(acc)
    return ordered.select("doc_id", F.explode(F.aggregate("m", begin, step, lambda acc: acc["out"])).alias("m")).select("doc_id", "m.*")
