"""Sinks: CSV, extension dispatch, partitioned splits, text lines, run bundles, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ensure_checkpoint_dir
from corpuslens.sources.readers import format_of


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint location (survives executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpuslens-tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint location and read back: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("escape", "\"")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    fmt = format_of(path)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", "\"")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.save(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One dataset, physically separated by split; readers prune partitions on ``split = ...``."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def text_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Training-corpus lines: stripped, blank or null texts skipped."""
    t = F.trim(F.regexp_replace(F.col(text_col), r"^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$", ""))
    return df.select(t.alias("value")).where(F.col("value").isNotNull() & (F.length("value") > 0))


def write_text_lines(df: DataFrame, path: str, text_col: str = "text") -> None:
    text_lines(df, text_col).write.mode("overwrite").text(path)


def run_bundle(df_one_row: DataFrame) -> DataFrame:
    """Metrics and parameters of one run as a single JSON document column."""
    return df_one_row.select(F.to_json(F.struct(*[F.col(c) for c in df_one_row.columns])).alias("bundle"))
