"""Label and flag contracts, shares, class weights and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DomainError(ValueError):
    pass


def strict_int(c: Column) -> Column:
    """Integer cast that truncates floats ('1.0' → 1) and raises on text under ANSI mode."""
    return c.cast("double").cast("int")


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(1))


def domain_violations(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """Distinct values of ``col`` outside ``allowed`` (set difference, one row per value)."""
    dom = df.sparkSession.createDataFrame([(v,) for v in allowed], f"{col} {df.schema[col].dataType.simpleString()}")
    return df.select(col).distinct().join(F.broadcast(dom), col, "left_anti")


def check_domain(df: DataFrame, col: str, allowed: list) -> None:
    """Fail mode: abort with the number of offending values and the first of them; ``domain_violations``
    has them all."""
    bad = domain_violations(df, col, allowed)
    n = bad.count()
    if n:
        first = [r[0] for r in bad.orderBy(col).limit(20).collect()]
        raise DomainError(f"{n} unexpected {col} values, the first: {first}; allowed {allowed}")


def shares(df: DataFrame, by: list[str], label_col: str = "label") -> DataFrame:
    """``n`` and normalised ``share`` of each label within each ``by`` group."""
    c = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return c.withColumn("share", F.col("n") / F.sum("n").over(w))


def class_weights(df: DataFrame, classes: list[int], label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` over the given rows (callers pass real train rows)."""
    k = len(classes)
    dom = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label_col} int")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    # k rows after the partial aggregate: the total is a window over that tiny table
    per = dom.join(counts, label_col, "left").select(label_col, F.coalesce("n_c", F.lit(0)).alias("n_c"))
    n = F.sum("n_c").over(Window.partitionBy())
    return per.select(label_col, "n_c", (n / (F.lit(k) * F.col("n_c"))).alias("weight"))


def sample_weights(df: DataFrame, weights: DataFrame, synth_weight: float = 0.3,
                   label_col: str = "label") -> DataFrame:
    """Row weight ``w_class[label] * (synth ? synth_weight : 1)``; the class table is k rows."""
    w = df.join(F.broadcast(weights.select(label_col, F.col("weight").alias("_wc"))), label_col, "left")
    return w.withColumn("sample_weight", F.col("_wc") * F.when(F.col("is_synth") == 1, F.lit(synth_weight))
                        .otherwise(F.lit(1.0))).drop("_wc")


def weighted_log_loss(df: DataFrame, logits: Column, y: Column, weight: Column) -> DataFrame:
    """Weighted cross-entropy ``-ln softmax(z)[y] * w`` in one pass; ``loss_mean_n`` divides by
    the row count (per-sample weighting then mean), ``loss_mean_w`` by the weight sum."""
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))
    nll = lse - F.element_at(logits, y + 1)
    per = df.select((nll * weight).alias("_l"), weight.alias("_w"))
    return per.agg((F.sum("_l") / F.count(F.lit(1))).alias("loss_mean_n"),
                   (F.sum("_l") / F.sum("_w")).alias("loss_mean_w"))
