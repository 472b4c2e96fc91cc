"""Reading, staging and row identity shared by the operators on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import scratch_path

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id the identity of a document: rows that repeat both are one document."""
    return F.xxhash64(whole_text(column))


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the frame once to the shared folder and read it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
