"""Exact row numbering without a single-partition window.

``Window.orderBy(...)`` with no partition (or a partition key that holds a third of the data)
funnels every row through one task. Here rows are range-partitioned on the ordering key, each
partition is numbered locally, and a per-partition offset table (one row per partition and
group) is added back. Work and memory per task stay bounded by the range-partition size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import reliable_checkpoint

# Offsets tables up to this many rows are broadcast; larger ones are shuffle-joined.
BROADCAST_ROWS = 1_000_000


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def row_index(df: DataFrame, order_cols: list, group_cols: list[str] | None = None,
              name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number()`` over ``group_cols`` ordered by ``order_cols``.

    ``order_cols`` must give a total order inside each group (end with a unique key), which
    also makes the numbering independent of input partitioning.
    """
    group_cols = list(group_cols or [])
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g) for g in group_cols], *[F.col(c) if isinstance(c, str) else c for c in order_cols]]
    # written once: range bounds are sampled, so a second evaluation could cut the partitions elsewhere
    r = reliable_checkpoint(df.repartitionByRange(n, *keys)
                            .sortWithinPartitions(*keys)
                            .withColumn("_pid", F.spark_partition_id())
                            .withColumn("_mid", F.monotonically_increasing_id()))
    stats = r.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    small = not group_cols or stats.count() <= BROADCAST_ROWS
    st = stats.select(*[F.col(c).alias(f"_s_{c}") for c in ["_pid", *group_cols]], "_first", "_off")
    st = F.broadcast(st) if small else st
    cond = r["_pid"] == st["_s__pid"]
    for g in group_cols:
        cond = cond & r[g].eqNullSafe(st[f"_s_{g}"])
    out = r.join(st, cond)
    return (out.withColumn(name, F.col("_mid") - F.col("_first") + F.col("_off") + 1)
            .drop("_pid", "_mid", "_first", "_off", *[f"_s_{c}" for c in ["_pid", *group_cols]]))


def dense_index(values: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """0-based dense index of the distinct values of ``col`` in ascending order."""
    distinct = values.select(col).distinct()
    return row_index(distinct, [col], name=name).withColumn(name, F.col(name) - 1)


def running_sum(df: DataFrame, order_cols: list, value_col: str, name: str = "cum",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` in the total order ``order_cols`` (unique last key).

    Same pattern as ``row_index``: range partitions, a local running sum per partition, and an
    offsets table with one row per partition (bounded by the partition count, so broadcast).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    r = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = reliable_checkpoint(r.withColumn("_local", F.sum(value_col).over(local)))  # see row_index
    stats = r.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_pid", F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(stats), "_pid")
            .withColumn(name, F.col("_local") + F.col("_off")).drop("_pid", "_local", "_off"))
