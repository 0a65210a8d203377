"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges (a, b); root is the smallest id of the component.

    Each round points every node at its smallest neighbour and contracts the edges, which at least
    halves the nodes. Minima are pre-aggregated, so a node with very many neighbours costs no more
    than its edges; rounds are written to the shared folder.
    """
    labels = None
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "up")
        labels = up if labels is None else stored(relabel(labels, up), "labels")
        ends = left.join(up.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        left = stored(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))


def relabel(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels (id, root) with each root replaced by its own root in ``roots``, and the ids that only ``roots`` has."""
    up = roots.select(F.col("id").alias("root"), F.col("root").alias("higher"))
    moved = labels.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("root"))
    return moved.unionByName(roots.join(labels.select("id"), "id", "left_anti"))
