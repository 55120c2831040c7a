"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ship_package
from corpuslens.sources.sinks import scratch_path

SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_KEPT: dict[tuple[str, str], object] = {}  # of a Python worker: what a task leaves for the next of the same operator


def kept_in_worker(key: tuple[str, str], make: Callable[[], object]) -> object:
    """The worker's value of ``key``, made by its first task. Values of other keys are given up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_up_kept() -> None:
    """Called by tasks that keep nothing: a worker serves all operators of a session and outlives each of them."""
    _KEPT.clear()


def in_python(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas`` with this package sent to the workers, wherever the driver was started."""
    ship_package(df.sparkSession)

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_up_kept()
        return run(frames)

    return df.mapInPandas(alone, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back: cuts the lineage,
    survives lost executors, and later readers prune columns."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII text takes the fast ``lower``; others are translated."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_group_stats(rows: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], salt: Column,
                     salts: int = SALTS) -> DataFrame:
    """Add per-group ``min`` / ``max`` / ``sum`` / ``count`` to every row, safe for hot groups.

    ``aggs`` maps a new column to ``(kind, source column)``. Rows are first reduced per
    (key, salt), then per key; the result goes back to each (key, salt), at most ``salts`` rows
    a key, so the join with the rows deals a hot key over ``salts`` sub-keys. Keys must not be null.
    """
    fn = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    again = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[fn[k](c).alias(n) for n, (k, c) in aggs.items()])
    whole = part.groupBy(*keys).agg(*[again[k](n).alias(n) for n, (k, _) in aggs.items()])
    back = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def join_back(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with one row per key, a key's rows dealt over ``salts`` sub-keys. Each row of ``small``
    is copied only to the sub-keys that have rows. Keys must not be null."""
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    back = salted.select(*keys, "_salt").distinct().join(small, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def by_bytes(frames: Iterator[pd.DataFrame], text: str, limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Cut batches so that one piece holds about ``limit`` characters (one text at least)."""
    for frame in frames:
        size = frame[text].str.len().fillna(0).cumsum()
        block = (size // limit).astype("int64")
        if len(block) == 0 or block.iloc[-1] == 0:
            yield frame
            continue
        for _, piece in frame.groupby(block.to_numpy(), sort=False):
            yield piece


def as_bytes(text: object) -> bytes:
    """UTF-8 of a text; null gives no bytes."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
