"""Contiguous shards of near equal bytes.

Rows lie in order of id. What a row's place in the bytes of all rows is comes from prefix sums over the totals of
ranges (``positions``); shard k holds the rows whose middle byte lies between k and k + 1 equal parts of the whole.
So every cut is at the row boundary next to its target, a shard's bytes differ from an equal part by a row at most,
and a table of ids and sizes is all that is shuffled. The law is 'bytes': equal texts are rows like others, as a group of copies can be larger than a shard.

Defined results: a null text has no bytes and the checksum of the empty text; null ids come first; rows of one id follow
one another in order of checksum and size; a row larger than an equal part leaves shards empty; an empty table gives no rows; extra columns, whatever
their names, are kept only where they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.positions import positions
from tessera.llm.tables import stored

#: Bytes that a row takes beside its text.
OVERHEAD = 8


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, the kept columns): slots count from 0 within each shard, in order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)])
    placed = positions(rows, ["doc_id", "text_crc32", "size"], ("size",))
    # twice the middle byte, so that all stays in whole numbers
    middle = F.expr(f"({shards} * (2 * size_before + size)) div (2 * size_total)").cast("int")
    cut = stored(placed.withColumn("shard", middle), "shards")
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("first"))  # one row a shard
    slots = cut.join(F.broadcast(firsts), "shard")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"), *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)])


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1_000_000) -> None:
    """All columns of the rows, in folders shard=0 and on, rows in order within files of a part of a shard's slots each.

    docs needs no columns of the names that ``shard`` gives besides its id.
    """
    others = tuple(c for c in docs.columns if c != id_col)
    placed = shard(docs, shards, id_col, text_col, others).drop("size", "text_crc32")
    part = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.repartition("shard", part).sortWithinPartitions("shard", "slot")
    dealt.withColumnRenamed("doc_id", id_col).write.partitionBy("shard").parquet(path)
