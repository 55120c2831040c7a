"""File sources: CSV (all-string or typed), extension dispatch, nested JSON pages, append."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.sources.schemas import API_PAGE


def _csv_reader(spark: SparkSession, schema: T.StructType, multi_line: bool):
    """``multi_line`` lets records hold line breaks, and makes one task of each file. Without it large files are
    split, so give False wherever no field holds a line break."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("mode", "PERMISSIVE"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_csv_all_string(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """Every column as string (ids never become floats); a missing path gives an empty frame."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return _csv_reader(spark, schema, multi_line).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Typed CSV scan with an explicit schema (no inference pass over the data)."""
    return _csv_reader(spark, schema, multi_line).csv(path)


FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".xlsx", ".xls"):
        raise ValueError("spreadsheet files are single-machine artefacts; convert to CSV or Parquet")
    if ext not in FORMATS:
        raise ValueError(f"unsupported extension {ext!r}; expected one of {sorted(FORMATS)}")
    return FORMATS[ext]


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Source dispatch on the (case-insensitive) file extension."""
    fmt = format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages (one JSON document per line) → one row per post with page metadata."""
    pages = spark.read.schema(API_PAGE).json(path)
    return explode_pages(pages)


def explode_pages(pages: DataFrame) -> DataFrame:
    """Flatten ``tweets`` arrays; pages without the key yield no rows."""
    return (pages
            .select(F.posexplode(F.coalesce(F.col("tweets"), F.array())).alias("pos", "tw"),
                    "has_next_page", "next_cursor")
            .select("pos", "tw.*", "has_next_page", "next_cursor"))


def append_batches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union aligned by name: old rows first, then new; either side may be empty."""
    return (old.withColumn("_batch", F.lit(0))
            .unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True))
