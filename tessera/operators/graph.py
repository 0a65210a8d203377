"""Connected components by hash-partitioned joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the edges (a, b): every node points at its smallest neighbour, edges are contracted, until none is left."""
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
        if labels is None:
            labels = up
        else:
            higher = up.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            labels = stored(labels.join(higher, "root", "left").select("id", F.coalesce("higher", "root").alias("root")))
        ends = left.join(up.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        left = stored(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels if labels is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))
