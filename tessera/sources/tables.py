"""Stage tables and inputs as Parquet, NDJSON exports, guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, warehouse: str, name: str, rows_per_file: int = 1_000_000) -> None:
    """A stage's table, replaced as a whole."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{warehouse}/{name}")


def require_table(spark: SparkSession, warehouse: str, name: str, stage: str) -> DataFrame:
    """The table, or an error that names the stage to run first."""
    try:
        return spark.read.parquet(f"{warehouse}/{name}")
    except Exception as e:
        raise RuntimeError(f"table {name} is missing: run the {stage} stage first") from e


def number(js: Column, path: str) -> Column:
    """A number of extended JSON at a path: wrapped in $numberInt, $numberLong or $numberDouble, or plain."""
    got = [F.get_json_object(js, f"$.{path}.${k}") for k in ("numberInt", "numberLong", "numberDouble")]
    plain = F.get_json_object(js, f"$.{path}")
    return F.coalesce(*got, F.when(~plain.startswith("{"), plain)).try_cast("double")


def text(js: Column, path: str) -> Column:
    """A text of extended JSON at a path: an $oid or a plain one."""
    plain = F.get_json_object(js, f"$.{path}")
    return F.coalesce(F.get_json_object(js, f"$.{path}.$oid"), F.when(~plain.startswith("{"), plain))


def without_tags(answer: Column) -> Column:
    """An answer without the author's and editor's tags behind it.

    A tag is up to 40 characters in angle brackets with no slash among them, up to four capitals in square ones, or up to two
    digits in round ones. The last one goes as often as there are closing brackets.
    """
    tags = {">": ("<", 40, lambda t: ~t.contains("/") & ~t.contains(">")), "]": ("[", 4, lambda t: F.rlike(t, F.lit("^[A-Z]*$"))), ")": ("(", 2, lambda t: F.rlike(t, F.lit("^[0-9]*$")))}
    bare = lambda t: F.regexp_replace(t, r"\s+$", "")

    def cut(text: Column) -> Column:
        body, out = F.left(text, F.length(text) - 1), text
        for closing, (opening, most, fits) in tags.items():
            inside = F.substring_index(body, opening, -1)
            tag = text.endswith(closing) & body.contains(opening) & F.length(inside).between(1, most) & fits(inside)
            out = F.when(tag, bare(F.left(text, F.length(text) - F.length(inside) - 2))).otherwise(out)
        return out

    clean = bare(answer)
    rounds = F.length(clean) - F.length(F.translate(clean, ">])", ""))
    return F.regexp_replace(F.aggregate(F.array_repeat(F.lit(0), rounds), clean, lambda left, _: cut(left)), r"^\s+", "")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records of an extended-JSON export, one a line."""
    return question_rows(spark.read.text(path))


def question_rows(lines: DataFrame) -> DataFrame:
    """Question records of lines (value); blank lines and lines without question or answer are left out.

    meta_score counts which of subcategory, alternate subcategory, difficulty, number and packet are filled.
    """
    js = F.col("value")
    rows = lines.where(F.trim("value") != "")
    plain = lambda name: F.get_json_object(js, f"$.{name}")
    filled = [F.when(F.coalesce(plain(c), F.lit("")) != "", 1).otherwise(0) for c in ("subcategory", "alternate_subcategory", "difficulty", "number", "packet")]
    got = rows.select(
        text(js, "_id").alias("id"), plain("question_sanitized").alias("question"), without_tags(plain("answer_sanitized")).alias("answer"),
        plain("category").alias("category"), plain("subcategory").alias("subcategory"), plain("alternate_subcategory").alias("alternate_subcategory"),
        number(js, "difficulty").cast(T.IntegerType()).alias("difficulty"), number(js, "number").cast(T.IntegerType()).alias("number"), number(js, "set.year").cast(T.IntegerType()).alias("year"),
        plain("set.name").alias("set_name"), plain("packet.name").alias("packet_name"), sum(filled[1:], filled[0]).alias("meta_score"),
    )
    return got.where((F.trim("question") != "") & (F.length("answer") > 0))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of fields with tabs between them, without a head."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def write_overrides(decided: DataFrame, existing: DataFrame | None, path: str) -> None:
    """Decisions (key, ...) as JSON lines in order of key; an existing one wins over another of its key."""
    every = decided.withColumn("rank", F.lit(1))
    if existing is not None:
        every = every.unionByName(existing.withColumn("rank", F.lit(0)))
    fields = [c for c in decided.columns if c != "key"]
    first = F.min_by(F.struct(*fields), F.struct("rank", *fields)).alias("first")
    every.groupBy("key").agg(first).select("key", "first.*").orderBy("key").write.mode("overwrite").json(path)
