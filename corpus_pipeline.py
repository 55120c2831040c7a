"""The training-corpus pipeline: five filtering and packing stages over ``documents``.

``STAGES`` lists them as (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``. ``run`` writes each stage's result
as Parquet into the shared checkpoint folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import decontaminate, exact_dedup, lang_id, near_dedup, packing
from corpuslens.llm.common import read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model cannot tell; it learns from the stage's own input."""
    return lang_id.filter_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays."""
    return near_dedup.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents that are left into sequences."""
    return packing.pack_digest(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", benchmark),
          ("packing", pack)]

ORACLE_SQL = None  # the language model, the near-copy groups and the tokenizer are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
