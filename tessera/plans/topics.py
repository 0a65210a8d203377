"""Topics of parts: a part is a group of its lines, its name the answer, its brand the category, a supplier what it may be linked to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize
from tessera.operators.topics import topic_table, with_topics
from tessera.plans.corpus import table


def topic_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables as `tessera.operators.topics` takes them.

    Every fifth name has an article, and every fiftieth its brand, which makes slugs meet. A part is linked to the supplier of more of its lines than
    any other's. Parts of one name in one order are alike. Links to suppliers with a number that 10 divides are taken back in brands whose name ends in 1.
    """
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_partkey is not null")
    n = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("members"))
    name = F.when(F.col("p_partkey") % 50 == 7, F.concat_ws(" ", "p_name", "p_brand")).when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("The "), F.initcap("p_name"))).otherwise(F.col("p_name"))
    groups = part.join(n, "p_partkey", "left").select(F.col("p_partkey").alias("group"), normalize(name).alias("key"), name.alias("name"), F.col("p_brand").alias("category"), F.coalesce("members", F.lit(0)).alias("members"))
    per = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).groupBy(F.col("l_partkey").alias("group"))
    most = lambda by: F.max_by("l_suppkey", F.struct("n", by))
    usual = per.agg(most(F.col("l_suppkey")).alias("s_suppkey"), most(-F.col("l_suppkey")).alias("least")).where(F.col("s_suppkey") == F.col("least"))  # both, if no other has as many
    links = usual.join(table(spark, sf_dir, "supplier"), "s_suppkey").select("group", F.concat(F.lit("S"), F.col("s_suppkey")).alias("topic"), F.col("s_name").alias("title"))
    unlinks = groups.join(links, "group").where(F.rlike("category", F.lit("1$")) & F.rlike("topic", F.lit("0$"))).select("key", "category", "topic")
    shared = line.select(F.col("l_partkey").alias("group"), F.col("l_orderkey").alias("thing"))
    return groups, links, unlinks, shared


def part_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's topic: a supplier's, or one of its own name."""
    return with_topics(*topic_inputs(spark, sf_dir)).select("group", "key", "topic")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic with its slug, name, sizes and usual category."""
    return topic_table(with_topics(*topic_inputs(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (part_topics, topics)}
ORACLES: dict[str, str] = {}
