"""Tables shared between the stages of an operator."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to Python at once, and the setting for it with Spark's default.
BATCH_BYTES = 4 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none (as in tests) is one made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: short lineage, and columns can be left unread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are done: it does so when the driver drops their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, unless the session has a setting of its own: both
    sides hold a batch whole, and 10,000 texts are tens of MB for each."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def set_apart(df: DataFrame, text_col: str, results: tuple[str, ...]) -> tuple[DataFrame, list[Column], Column]:
    """The rows under numbered column names, which clash with none; their columns under the old names, but for
    those that results replace; and the text."""
    apart = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    taken = {r.lower() for r in results}
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in taken]
    return apart, kept, F.col(f"c{[c.lower() for c in df.columns].index(text_col.lower())}").cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that other columns can have any name."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
