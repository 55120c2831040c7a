"""Salted equi-join for a few very hot keys.

``big`` has many rows per key, ``small`` one row per key. Keys whose row count exceeds
``threshold`` are at most ``total_rows / threshold`` many; that set is counted and broadcast only
when it is within ``MAX_HOT_KEYS`` (it is joined by shuffle otherwise). Big-side rows of a hot key
are spread over ``salts`` sub-keys and the matching small-side row is replicated ``salts`` times,
so a key holding a third of all rows is processed by ``salts`` tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100_000


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, salts: int,
                salt_source: Column, n_hot: int | None = None) -> DataFrame:
    """Inner join on ``keys``; rows of keys listed in ``hot`` are split over ``salts`` sub-keys.

    ``n_hot`` (the size of ``hot``) may be passed when already known, e.g. in a loop."""
    if n_hot is None:
        n_hot = hot.count()  # one scalar: size check before broadcasting
    if n_hot == 0:
        return big.join(small, keys)
    flag = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    flag = F.broadcast(flag) if n_hot <= MAX_HOT_KEYS else flag
    b = (big.join(flag, keys, "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt_source, F.lit(salts))).otherwise(F.lit(0)))
         .drop("_hot"))
    s = (small.join(flag, keys, "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                        .otherwise(F.array(F.lit(0)))))
         .drop("_hot"))
    return b.join(s, [*keys, "_salt"]).drop("_salt")
