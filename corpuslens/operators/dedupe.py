"""Exact de-duplication, caps per group and top-k.

Skew: one text may be a third of all rows. Grouping uses a partial (map-side) aggregate over a
256-bit digest, so each task ships at most one row per distinct text; survivors are found by a
semi join on the unique order key, which spreads evenly however hot a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_digest(c: Column) -> Column:
    """Compact grouping key for long texts; nulls stay null (one group, like the reference)."""
    return F.sha2(c, 256)


def dedupe_exact_first(df: DataFrame, key: str = "text", order_key: str = "seq") -> DataFrame:
    """Keep the first row (smallest ``order_key``) of every distinct ``key``; nulls compare equal."""
    firsts = (df.groupBy(text_digest(F.col(key)).alias("_k"))
              .agg(F.min(order_key).alias(order_key))
              .select(order_key))
    return df.join(firsts, order_key, "left_semi")


def dedupe_report(df: DataFrame, key: str = "text") -> DataFrame:
    """Rows before, removed and after an exact text dedupe (one row)."""
    k = text_digest(F.col(key))
    distinct = F.count_distinct(k) + F.max(F.col(key).isNull().cast("long"))
    return (df.agg(F.count(F.lit(1)).alias("rows_before"), distinct.alias("rows_after"))
            .select("rows_before", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
                    "rows_after"))


def cap_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], cap: int) -> DataFrame:
    """Latest ``cap`` rows per group. ``row_number() <= cap`` is planned as a window group limit,
    so each task pre-trims its rows to ``cap`` per group before the shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def top_k(df: DataFrame, order_cols: list[Column], k: int) -> DataFrame:
    """Global top-k (planned as TakeOrderedAndProject: per-task top-k, then a k-way merge)."""
    return df.orderBy(*order_cols).limit(k)


def keep_first_per_group(df: DataFrame, group_col: str, order_key: str) -> DataFrame:
    """One representative (smallest ``order_key``) per group via aggregate + semi join."""
    firsts = df.groupBy(group_col).agg(F.min(order_key).alias(order_key)).select(order_key)
    return df.join(firsts, order_key, "left_semi")
