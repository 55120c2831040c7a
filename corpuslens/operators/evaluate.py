"""Confusion matrices, classification reports and the single-pass threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((2 * tp) / den)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_matrix(df: DataFrame, y: str, yhat: str, labels: list[int]) -> DataFrame:
    """Long form ``(y, y_pred, n)`` with every cell of the fixed label order, zeros kept.

    A row whose label or prediction is null or outside ``labels`` fails the job; it would otherwise
    be missing from support and accuracy.
    """
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "y int, y_pred int")

    def known(name: str) -> Column:
        value = F.col(name).cast("int")
        text = F.concat(F.lit(f"{name} is outside {labels}: "), F.coalesce(value.cast("string"), F.lit("null")))
        return F.when(value.isin(labels), value).otherwise(F.raise_error(text).cast("int"))

    counts = df.groupBy(known(y).alias("y"), known(yhat).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    # both sides are at most |labels|^2 rows
    return cells.join(F.broadcast(counts), ["y", "y_pred"], "left") \
        .select("y", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, y: str, yhat: str, labels: list[int], digits: int = 4) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted averages."""
    cm = confusion_matrix(df, y, yhat, labels)
    per = (cm.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"),
                                                    F.sum(F.when(F.col("y") == F.col("y_pred"), F.col("n"))).alias("tp"))
           .join(cm.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted")), "label"))
    per = per.select(F.col("label").cast("string").alias("row"), "support",
                     safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                     safe_div(F.col("tp"), F.col("support")).alias("recall"), "tp")
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
                         .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    tot = F.sum("support").over(Window.partitionBy())
    per = per.withColumn("_total", tot)
    k = len(labels)
    summary = per.agg(
        F.first("_total").alias("support"),
        (F.sum("tp") / F.first("_total")).alias("acc"),
        (F.sum("precision") / k).alias("mp"), (F.sum("recall") / k).alias("mr"), (F.sum("f1_score") / k).alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.first("_total")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("_total")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.first("_total")).alias("wf"))
    rows = [per.select("row", "precision", "recall", "f1_score", "support"),
            summary.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                           F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"), "support"),
            summary.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                           F.col("mf").alias("f1_score"), "support"),
            summary.select(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                           F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), "support")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def grid_index(p: Column, start: float, step: float, n: int) -> Column:
    """Highest grid index k in [0, n) with ``start + k*step <= p`` (-1 if none), exact at edges.

    ``floor`` gives a first guess; comparing against the neighbouring grid values in the same
    double arithmetic makes ``>=`` agree bit for bit with a brute-force comparison.
    """
    k0 = F.floor((p - F.lit(start)) / F.lit(step)).cast("long")
    thr = lambda k: F.lit(start) + k.cast("double") * F.lit(step)
    k1 = F.when(thr(k0 + 1) <= p, k0 + 1).when(thr(k0) > p, k0 - 1).otherwise(k0)
    return F.when(p.isNull(), F.lit(None)).otherwise(F.least(F.greatest(k1, F.lit(-1)), F.lit(n - 1)))


def threshold_sweep(df: DataFrame, prob: str, y: str, start: float = 0.0, step: float = 0.005,
                    n: int = 200) -> DataFrame:
    """Macro-F1 of ``prob >= start + k*step`` for every k, in one pass over the rows.

    Rows are bucketed to their highest reached grid index and counted per (k, label) with a
    partial aggregate; reverse running sums over the bounded grid (n rows) give the confusion
    counts at every threshold. The reference rescans all rows once per threshold.

    A row whose score is null or not a number, or whose label is not 0 or 1, fails the job; it would
    otherwise be missing from every count.
    """
    spark: SparkSession = df.sparkSession
    score, label = F.col(prob).cast("double"), F.col(y).cast("int")
    score = F.when(score.isNotNull() & ~F.isnan(score), score).otherwise(
        F.raise_error(F.concat(F.lit(f"{prob} is no score: "), F.coalesce(score.cast("string"), F.lit("null")))).cast("double"))
    label = F.when(label.isin(0, 1), label).otherwise(
        F.raise_error(F.concat(F.lit(f"{y} is neither 0 nor 1: "), F.coalesce(F.col(y).cast("string"), F.lit("null")))).cast("int"))
    checked = df.select(score.alias("p"), label.alias("y"))
    counts = (checked.select(grid_index(F.col("p"), start, step, n).alias("k"), "y")
              .groupBy("k").agg(F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0")))
    grid = spark.range(-1, n).select(F.col("id").alias("k"))
    g = grid.join(F.broadcast(counts), "k", "left").fillna(0, ["c1", "c0"])
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    g = (g.withColumn("tp", F.sum("c1").over(suffix)).withColumn("fp", F.sum("c0").over(suffix))
         .withColumn("P", F.sum("c1").over(whole)).withColumn("N", F.sum("c0").over(whole))
         .where(F.col("k") >= 0))
    g = g.select("k", (F.lit(start) + F.col("k").cast("double") * F.lit(step)).alias("threshold"),
                 "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    macro = (f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2
    return g.withColumn("macro_f1", macro)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest macro-F1; ties go to the lowest threshold (one row)."""
    return sweep.orderBy(F.col("macro_f1").desc(), F.col("k").asc()).limit(1).select("threshold", "macro_f1")
