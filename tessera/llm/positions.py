"""Places of rows in a total order, without a sort in one task.

Rows are dealt into ranges of the order and stored with their range's number. Each range gives its totals; prefix
sums over the totals, one row a range, say what comes before a range, and a running sum within each range says the
rest. The last key of every order is a number that the rows get when they are stored, so that no key, however many
rows share it, is bound to one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import stored

#: Rows of a range, where there are more than spark.sql.shuffle.partitions ranges of this size.
ROWS_PER_RANGE = 1_000_000


def positions(rows: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``rows_before`` and, for each column c of sums, ``c_before`` and ``c_total``.

    Order is ascending, nulls first; rows equal in it follow one another in any order. Values of sums are whole numbers.
    Names that begin with an underscore are taken.
    """
    spark = rows.sparkSession
    narrow = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // ROWS_PER_RANGE))
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_row"]]
    dealt = stored(narrow.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    every = Window.partitionBy()
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    bases = totals.select(
        "_range", so_far("_rows", earlier).alias("_rows_base"), *[so_far(f"_sum_{c}", earlier).alias(f"_base_{c}") for c in sums], *[so_far(f"_sum_{c}", every).alias(f"{c}_total") for c in sums]
    )
    within = Window.partitionBy("_range").orderBy(*keys)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({"_place": F.row_number().over(within) - 1} | {f"_in_{c}": so_far(c, before) for c in sums})
    placed = inner.join(F.broadcast(bases), "_range")  # ranges are few: one a million rows
    return placed.select(
        *rows.columns, (F.col("_rows_base") + F.col("_place")).alias("rows_before"), *[(F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums]
    )
