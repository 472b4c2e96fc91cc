"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame, which ``run``
writes as Parquet and reads again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import exact_dedup, near_dedup, packing, quality_rules, substring_dedup
from marketlens.llm.common import staged, table
from marketlens.llm.queries import ORACLE_SQL as _OPERATOR_SQL
from marketlens.llm.queries import QUERIES as _OPERATORS
from marketlens.llm.queries import WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language."""
    return quality_rules.apply(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that came earlier."""
    return substring_dedup.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("pack", pack)]

#: Packing needs the tokenizer, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {**_OPERATORS, "pipeline": run}
SQL = {**_OPERATOR_SQL, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
