"""Names of parts in the texts of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import names as N
from tessera.plans.corpus import table


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of part names as topics: the whole name as a title, its noun as the main name of every name that ends with it, and what a brand calls "new"."""
    part = table(spark, sf_dir, "part").where("p_name is not null")
    topics = part.groupBy(F.col("p_name").alias("owner")).agg(F.min("p_type").alias("category"), F.min("p_brand").alias("brand"))
    whole = topics.select("owner", "category", F.initcap("owner").alias("alias"), F.lit("title").alias("source"), F.lit(2.0).alias("weight"))
    noun = topics.select("owner", "category", F.initcap(F.element_at(F.split("owner", " "), -1)).alias("alias"), F.lit("main").alias("source"), F.lit(1.0).alias("weight"))
    new = topics.select("owner", "category", F.concat(F.lit("new "), "owner").alias("alias"), F.lit("accept").alias("source"), F.lit(1.5).alias("weight"))
    back = topics.select("brand", "category", F.concat(F.initcap("owner"), F.lit(" Works")).alias("alias"), F.lit("required").alias("source"), F.lit(1.0).alias("weight")).withColumnRenamed("brand", "owner")
    return N.dictionary(whole.unionByName(noun).unionByName(new).unionByName(back))


def named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order (id, text, category, exclude): its lines' part names in one of 8 ways, by line; the category is the first line's part's."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    big, noun = F.initcap("p_name"), F.initcap(F.element_at(F.split("p_name", " "), -1))
    ways = [big, F.col("p_name"), noun, F.concat(F.lit("new "), "p_name"), F.concat(F.lit("of "), big, F.lit(" Works")), F.concat(F.lit("the "), big, F.lit("'s lid")), F.concat(F.lit("Dr. "), noun), F.concat(noun, F.lit(","))]
    form = F.get(F.array(*ways), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(ways))).cast("int"))
    line = F.struct("l_linenumber", "l_partkey", form.alias("form"), "p_type")
    texts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))  # the lines of one order
    return texts.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("ls", lambda x: x["form"]), " with ").alias("text"), F.get("ls", F.lit(0))["p_type"].alias("category"), F.lit(None).cast("string").alias("exclude"))


def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the topic they mean: places and orders. "red" counts as a word that names begin with."""
    like = spark.createDataFrame([("red",)], "word string")
    found = N.find(named_texts(spark, sf_dir), part_names(spark, sf_dir), like)
    return found.groupBy("key", "owner").agg(F.count("*").alias("n_mentions"), F.countDistinct("id").alias("n_texts"))


QUERIES = {f.__name__: f for f in (name_mentions,)}
ORACLES: dict[str, str] = {}
