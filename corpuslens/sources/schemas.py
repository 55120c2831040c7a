"""Explicit schemas and column contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Output column order of the post table.
POST_COLUMNS = ["type", "id", "url", "tags", "text", "createdAt", "location",
                "authorUserName", "university", "group"]

POST_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in POST_COLUMNS])

AUTHOR = T.StructType([
    T.StructField("location", T.StringType(), True),
    T.StructField("userName", T.StringType(), True),
])

API_TWEET = T.StructType([
    T.StructField("type", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("createdAt", T.StringType(), True),
    T.StructField("author", AUTHOR, True),
])

API_PAGE = T.StructType([
    T.StructField("tweets", T.ArrayType(API_TWEET), True),
    T.StructField("has_next_page", T.BooleanType(), True),
    T.StructField("next_cursor", T.StringType(), True),
])

SPLIT_SCHEMA = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("is_synth", T.IntegerType(), True),
])


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Fail before any action when required columns are absent; the error names the missing set."""
    missing = set(needed) - set(df.columns)
    if missing:
        raise MissingColumnsError(f"missing columns: {sorted(missing)}; required: {sorted(set(needed))}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed output schema: add absent columns as typed nulls, drop extras, reorder."""
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
