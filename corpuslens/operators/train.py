"""Weighted binary classifier trained on the train split only, tuned on val, reported on test.

Same row weight as the reference's weighted loss: balanced class weight (real train rows)
times ``synth_weight`` for synthetic rows. The institution is an extra input token
(target-aware input).

The model is a sparse logistic regression on hashed words, fitted by accelerated proximal gradient steps.
Every epoch is one Spark job over the stored feature rows: a task adds up the gradient, the train loss and
the validation counts of its rows, partial sums are added in a tree by blocks of features, and the driver
takes the step; it holds a few vectors of ``BUCKETS`` numbers, whatever the data. Training stops when the
validation loss has not fallen for ``PATIENCE`` epochs, and the weights of its lowest point are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import evaluate as E
from corpuslens.operators import labels as L
from corpuslens.session import ship_package
from corpuslens.sources.sinks import written

BUCKETS, MIN_DF = 1 << 18, 2  # hashed words, and rows that a bucket must occur in
L1, EPOCHS, PATIENCE = 0.002, 40, 5
CURVATURE = 0.5  # bound of the loss's second derivative for feature vectors of length 1 and a bias
BLOCK, FAN_IN = 4096, 64
TOKEN_SPLIT = r"[^\p{L}\p{N}_<>@]+"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    idf: np.ndarray
    log: list[tuple[int, float, float, float]] = field(default_factory=list)  # epoch, loss, eval_loss, eval_macro_f1


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """Hash bucket of every word; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def inverse_frequency(rows: DataFrame, n: int = BUCKETS, min_df: int = MIN_DF) -> np.ndarray:
    """log((rows + 1) / (df + 1)) per bucket over ``rows(words)``, 0 for buckets in fewer than ``min_df`` rows; at most
    one number per bucket reaches the driver."""
    total = rows.count()
    df = (rows.select(F.explode(F.array_distinct("words")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("df"))
          .where(F.col("df") >= min_df).toPandas())
    idf = np.zeros(n)
    idf[df["k"].to_numpy(dtype=np.int64)] = np.log((total + 1) / (df["df"].to_numpy(dtype=np.float64) + 1))
    return idf


def vector(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, (1 + log count) * idf, scaled to length 1."""
    k, count = np.unique(np.asarray(words, dtype=np.int64), return_counts=True)
    v = (1 + np.log(count)) * idf[k]
    k, v = k[v > 0], v[v > 0]
    return k, v / np.linalg.norm(v) if len(v) else v


def _vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """``rows(is_val, y, weight, words)`` with the words as feature vectors ``k, v``."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [vector(w, shared.value) for w in frame["words"]]
            yield pd.DataFrame({"is_val": frame["is_val"], "y": frame["y"], "weight": frame["weight"],
                                "k": [k.astype(np.int32) for k, _ in made], "v": [v for _, v in made]})

    return rows.mapInPandas(run, "is_val boolean, y double, weight double, k array<int>, v array<double>")


def _margins(frame: pd.DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = frame["k"].str.len().to_numpy(dtype=np.int64)
    k = np.concatenate([np.empty(0, np.int64), *frame["k"]]).astype(np.int64)
    v = np.concatenate([np.empty(0), *frame["v"]])
    row = np.repeat(np.arange(len(frame)), size)
    return np.bincount(row, weights[k] * v, minlength=len(frame)) + bias, row, k, v


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-15, 1))


N_SUMS = 10  # train weight, bias gradient, train loss, val weight, val loss, val tp fp fn tn, rows


def _pass(rows: DataFrame, ahead: tuple[np.ndarray, float], now: tuple[np.ndarray, float]) -> np.ndarray:
    """One epoch's sums: the gradient at ``ahead`` by bucket, and behind it the ``N_SUMS`` others, of which the losses and
    validation counts are at ``now``. Tasks emit blocks; blocks are added in groups of ``FAN_IN`` tasks, then whole."""
    n = len(ahead[0])
    shared = rows.sparkSession.sparkContext.broadcast((ahead, now))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (z, bz), (w, b) = shared.value
        total = np.zeros(n + N_SUMS)
        for frame in frames:
            y, weight, val = (frame[c].to_numpy() for c in ("y", "weight", "is_val"))
            margin, row, k, v = _margins(frame, z, bz)
            r = np.where(val, 0.0, weight * (_sigmoid(margin) - y))
            total[:n] += np.bincount(k, r[row] * v, minlength=n)
            p = _sigmoid(_margins(frame, w, b)[0])
            loss, hit = weight * _loss(y, p), p >= 0.5
            pairs = [val & hit & (y == 1), val & hit & (y == 0), val & ~hit & (y == 1), val & ~hit & (y == 0)]
            total[n:] += [weight[~val].sum(), r.sum(), loss[~val].sum(), weight[val].sum(), loss[val].sum(),
                          *[x.sum() for x in pairs], len(frame)]
        cut = [total[i:i + BLOCK] for i in range(0, len(total), BLOCK)]
        yield pd.DataFrame({"block": range(len(cut)), "part": cut})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [np.sum(np.stack(frame["part"]), axis=0)]})

    parts = rows.mapInPandas(run, "block int, part array<double>")
    if rows.rdd.getNumPartitions() > FAN_IN:
        lanes = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        parts = lanes.groupBy("block", "lane").applyInPandas(add, "block int, part array<double>")
    whole = parts.groupBy("block").applyInPandas(add, "block int, part array<double>").collect()
    return np.concatenate([r.part for r in sorted(whole, key=lambda r: r.block)])


def _f1(tp: float, fp: float, fn: float) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def descend(one_pass, n: int, l1: float = L1, epochs: int = EPOCHS, patience: int = PATIENCE) -> tuple[np.ndarray, float, list]:
    """Accelerated proximal gradient steps on the sums that ``one_pass(ahead, now)`` gives; the weights and bias of the
    lowest validation loss (of the last epoch without validation rows), and the metric log."""
    w, b, z, bz, t = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    log: list[tuple[int, float, float, float]] = []
    best, since = (np.inf, w, b), 0
    for epoch in range(epochs):
        sums = one_pass((z, bz), (w, b))
        weight, bias, loss, val_weight, val_loss, tp, fp, fn, tn, _ = sums[n:]
        held = val_loss / val_weight if val_weight else -float(epoch)
        log.append((epoch, float(loss / max(weight, 1e-300)), float(held if val_weight else np.nan),
                    float(_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2))
        if held < best[0]:
            best, since = (held, w, b), 0
        else:
            since += 1
        if since > patience or not weight:
            break
        step = z - sums[:n] / weight / CURVATURE
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / CURVATURE, 0)
        new_bias = bz - bias / weight / CURVATURE
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, bz = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - b)
        w, b, t = new, new_bias, after
    return best[1], best[2], log


def fit_weighted(train: DataFrame, val: DataFrame, text_col: str = "input", label_col: str = "label",
                 synth_weight: float = 0.3, n: int = BUCKETS, min_df: int = MIN_DF, l1: float = L1, epochs: int = EPOCHS,
                 patience: int = PATIENCE) -> Model:
    ship_package(train.sparkSession)
    weights = L.class_weights(train.where(F.col("is_synth") == 0), [0, 1], label_col)
    both = [L.sample_weights(df, weights, synth_weight, label_col).select(
        F.lit(is_val).alias("is_val"), F.col(label_col).cast("double").alias("y"),
        F.col("sample_weight").cast("double").alias("weight"), buckets(F.col(text_col), n).alias("words"))
        for df, is_val in ((train, False), (val, True))]
    rows = written(both[0].unionByName(both[1]), "words")
    idf = inverse_frequency(rows.where(~F.col("is_val")), n, min_df)
    features = written(_vectors(rows, idf), "features")
    w, b, log = descend(lambda ahead, now: _pass(features, ahead, now), n, l1, epochs, patience)
    return Model(w, b, idf, log)


def prob_pos(model: Model, df: DataFrame, text_col: str = "input") -> DataFrame:
    """``df`` with ``prob_pos``."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.idf))

    @F.pandas_udf("double")
    def score(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b, idf = shared.value
        for batch in words:
            made = [vector(x, idf) for x in batch]
            yield pd.Series(_sigmoid(np.array([w[k] @ v + b for k, v in made], dtype=np.float64)))

    return df.withColumn("prob_pos", score(buckets(F.col(text_col), len(model.weights))))


def metric_log(spark, model: Model) -> DataFrame:
    """One row per epoch: ``epoch, loss, eval_loss, eval_macro_f1``."""
    return spark.createDataFrame(model.log, "epoch int, loss double, eval_loss double, eval_macro_f1 double")


def train_eval(splits: DataFrame, text_col: str = "input", label_col: str = "label",
               synth_weight: float = 0.3) -> DataFrame:
    """Fit on train, tune the macro-F1 threshold on val, classification report on test."""
    train, val, test = (splits.where(F.col("split") == name) for name in ("train", "val", "test"))
    model = fit_weighted(train, val, text_col, label_col, synth_weight)
    best = E.best_threshold(E.threshold_sweep(prob_pos(model, val, text_col), "prob_pos", label_col)).first()
    thr = best["threshold"] if best else 0.5
    scored = prob_pos(model, test, text_col).withColumn("y_pred", (F.col("prob_pos") >= F.lit(thr)).cast("int"))
    return E.classification_report(scored, label_col, "y_pred", [0, 1]).withColumn("threshold", F.lit(thr))
