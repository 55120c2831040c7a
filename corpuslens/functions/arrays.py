"""Array scalars: softmax, arg-max, padding and the 32-bit shingle hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(c: Column) -> Column:
    """Numerically stable softmax of an ``array<double>``."""
    m = F.array_max(c)
    ex = F.transform(c, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(c: Column) -> Column:
    """0-based index of the largest element; ties go to the first index."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def pad_sequence(c: Column, maxlen: int, pad: int = 0) -> Column:
    """Pad with ``pad`` or truncate to exactly ``maxlen`` elements."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(pad), maxlen)), 1, maxlen)


def hash32(c: Column) -> Column:
    """First 32 bits of md5 as a non-negative bigint (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def seeded_order(seed: int, stage: str, key: Column) -> Column:
    """Partition-independent pseudo-random order key: ``md5('<seed>|<stage>|' || key)``."""
    return F.md5(F.concat(F.lit(f"{seed}|{stage}|"), key.cast("string")))
