"""Running sums and places within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import stored


def running(rows: DataFrame, group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """The rows with the sum of a value up to and including each, within its group in an order that has no ties.

    Rows are cut into ranges of (group, order); what comes before a range are the totals of the group's earlier ranges, of which
    there is one row for each range and group. So the largest group is spread over as many tasks as its share of the rows asks for.
    """
    cut = stored(rows.withColumn("_value", value).repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy(group, "_range").agg(F.sum("_value").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("_inside", F.sum("_value").over(inside)).join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn(name, F.col("_inside") + F.col("_before")).drop("_value", "_range", "_group", "_at", "_before", "_inside")


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with their place from 1 within their group."""
    return running(rows, group, order, F.lit(1).cast("long"), name)


def medians(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """(group, median) of counted values: rows (group, value, n), one for each value of a group; null values don't count, a group of these only has no row.

    The middle places are found by running sums, so a group's values are never gathered in one task.
    """
    placed = running(counts.where(F.col(value).isNotNull()).select(group, value, n), group, [F.col(value)], F.col(n), "_upto")
    total = placed.groupBy(F.col(group).alias("_of")).agg(F.max("_upto").alias("_total"))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value))).cast("double")
    lower, upper = at(F.floor((F.col("_total") + 1) / 2)), at(F.floor(F.col("_total") / 2) + 1)
    return placed.join(total, F.col(group).eqNullSafe(F.col("_of"))).groupBy(group).agg(((lower + upper) / 2).alias("median"))
