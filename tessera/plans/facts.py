"""Facts of vectors and their documents' rare words: clusters, labels with support, and clusters of one fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.facts import clusters, described
from tessera.plans.corpus import table
from tessera.sources.tables import stored

#: Letters of the words that are taken for terms.
LONG = 11


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, id, vector, terms, source): vectors by label, with the long words of the document of the same number."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b[a-z]{{{LONG},}}\b"), F.lit(0))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", found.alias("terms"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(docs, "id", "left")


def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster by likeness of vectors and shared terms."""
    return clusters(fact_rows(spark, sf_dir), threshold=0.7, bonus=0.2)


def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with label, support, sources of the core, whether they count, anchors, and how many others state the same fact."""
    rows = stored(fact_rows(spark, sf_dir))  # the texts are read once
    members = stored(rows.select("topic", "id", "source", "terms").join(clusters(rows, threshold=0.7, bonus=0.2), ["topic", "id"]))
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n"))
    own = spark.createDataFrame([(0, "the")], "topic long, word string")
    labels, same = described(members, own, sizes)
    ends = same.select("topic", F.explode(F.array("a", "b")).alias("cluster")).groupBy("topic", "cluster").agg(F.count("*").alias("same_fact"))
    return labels.join(ends, ["topic", "cluster"], "left").select("topic", "cluster", "n", "label", "support", "sources", "eligible", F.array_join("anchors", ",").alias("anchors"), F.coalesce("same_fact", F.lit(0)).alias("same_fact"))


QUERIES = {f.__name__: f for f in (fact_clusters, fact_labels)}
ORACLES: dict[str, str] = {}
