"""From raw documents to token digests, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again, and works on all of it.

- toxicity: learns from ``labels`` and drops documents scored 0.5 or more.
- near_duplicates: of each group of documents linked by word shingles, the one with the smallest doc_id
  stays (null ids come last). Rows of one id, or of none, are told apart by their sets: each leaves or stays with its own group, and of rows
  equal in id and set one stays; of rows without words those equal in id and text are one.
- decontamination: drops documents that hold a window of a benchmark item.
- personal_data: replaces found spans by their kind; n_chars follows the text.
- tokens: ids and decoded text, as counts and digests.

Ids are numbers or texts that the session's cast takes for numbers. Null texts have no features, words or spans: they pass the filters (each is a group of its own) and end as begin and end ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ftrl, parity_join, pii, sentencepiece_codec
from tessera.llm.tables import small_batches, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = ftrl.train(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels)
    return docs.where(ftrl.score_column(docs, F.col("text").cast("string"), weights) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = [F.col(f"`{c}`") for c in docs.columns]
    linked = parity_join.link(docs)
    grouped = linked.where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = stored(grouped.groupBy("component").agg(F.min(order).alias("b")).select("component", F.col("b.doc_id").alias("first"), F.col("b.node").alias("stays")), "best")
    leaving = stored(grouped.join(best.where("first is not null"), "component").where("doc_id <> first").select(F.col("doc_id").alias("_leaving")).distinct(), "leaving")
    repeated = stored(linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_repeated")), "repeated")
    none = docs.where("doc_id is null")
    some, nulls = not repeated.isEmpty(), not none.select("doc_id").isEmpty()
    known = docs.where("doc_id is not null") if nulls else docs
    if not some and not nulls:
        return known.join(leaving, F.col("doc_id") == F.col("_leaving"), "left_anti").select(*own)
    # an id of several rows, or none, doesn't tell which of its rows is meant: their sets do
    same = F.col("doc_id") == F.col("_repeated")
    again = known.join(repeated, same, "left_semi").unionByName(none).withColumn("_node", parity_join.node_column(F.col("text").cast("string")))
    empty = again.where("_node is null").dropDuplicates(["doc_id", "text"])
    full = again.where("_node is not null").dropDuplicates(["doc_id", "_node"])
    stays = full.join(best, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("_node") == F.col("stays")), "left_semi")
    single = known.join(repeated, same, "left_anti").join(leaving, F.col("doc_id") == F.col("_leaving"), "left_anti")
    return single.select(*own).unionByName(stays.select(*own)).unionByName(empty.select(*own))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    text = docs.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns])
    marked = decontaminate.mark(text, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col="_text")
    return marked.where("n_hit = 0").select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = sentencepiece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: A learned classifier and a tokenizer can't be written in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
