"""Model-input preparation, pluggable distributed batch scoring, label mapping and abstention.

Scoring runs in an iterator pandas UDF: Spark partitions the rows, each Python worker loads the model
once and scores Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows each).
Everything around the model (input composition, softmax, arg-max, mapping, abstention,
schema conformance) is native column expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.arrays import argmax, softmax
from corpuslens.functions.text import normalize_predict
from corpuslens.session import ship_package

# Internal ↔ external label codes and class names of the 3-class labeller.
TO_INTERNAL = {0: 0, 1: 1, 9: 2}
TO_EXTERNAL = {0: 0, 1: 1, 2: 9}
NAMES_3 = {0: "negatif", 1: "pozitif", 2: "alakasiz"}
NAMES_2 = {0: "0_olumsuz", 1: "1_olumlu"}
INPUT_PREFIX = "Üniversite: "
INPUT_SEP = " || "
DEFAULT_ABSTAIN = 0.58


def build_model_input(university: Column, text: Column, clean: bool = True, null_as: str = "nan") -> Column:
    """``"Üniversite: <u> || <t>"``; missing values become ``"nan"`` like the reference's str cast."""
    t = normalize_predict(F.coalesce(text, F.lit(null_as))) if clean else F.coalesce(text, F.lit(null_as))
    return F.concat(F.lit(INPUT_PREFIX), F.coalesce(university, F.lit(null_as)), F.lit(INPUT_SEP), t)


def map_codes(c: Column, mapping: dict) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def abstain(label: Column, pmax: Column, thresh: float = DEFAULT_ABSTAIN) -> Column:
    """Predicted 0/1 with max probability below ``thresh`` → 9; predicted 9 unchanged."""
    return F.when(label.isin(0, 1) & (pmax < F.lit(thresh)), F.lit(9)).otherwise(label)


# ---- pluggable model -------------------------------------------------------------------
# A model is a picklable factory returning ``predict(texts: pd.Series) -> np.ndarray[B, C]`` of
# logits; it is built once per Python worker process (first batch) and reused.

IRRELEVANT_LOGIT = 0.5


def lexicon_model(positive: list[str], negative: list[str]) -> Callable:
    """Factory of a bag-of-words model: logits = [negative hits, positive hits, 0.5], by whole one-word terms."""
    terms = [{t.lower() for t in words if " " not in t} for words in (negative, positive)]

    def factory() -> Callable:
        def predict(texts: pd.Series) -> np.ndarray:
            words = pd.Series([re.findall(r"\w+", t.lower()) if isinstance(t, str) else [] for t in texts], dtype=object).explode()
            hits = [words.isin(t).groupby(level=0).sum().to_numpy(dtype=np.float64) for t in terms]
            return np.column_stack([*hits, np.full(len(texts), IRRELEVANT_LOGIT)])
        return predict
    return factory


_MODEL_CACHE: dict = {}


def score_logits(df: DataFrame, input_col: str, keep: list[str], model_factory: Callable, n_classes: int = 3) -> DataFrame:
    """Append ``logits array<double>`` computed by the pluggable model on Arrow batches.

    An iterator pandas UDF: only the input column crosses into Python (other columns stay in
    the JVM), and the model is built once per Python worker and job, and reused across batches.
    """
    ship_package(df.sparkSession)
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _MODEL_CACHE.get(key)
        if model is None:
            _MODEL_CACHE.clear()  # a worker serves one job after the other
            model = _MODEL_CACHE[key] = model_factory()
        for b in batches:
            z = model(b)
            yield pd.Series(list(z[:, :n_classes]))

    return df.select(*keep, logits(F.col(input_col)).alias("logits"))


def label_from_logits(df: DataFrame, thresh: float = DEFAULT_ABSTAIN) -> DataFrame:
    """probabilities → internal arg-max → external 0/1/9 → abstain on low confidence."""
    p = df.withColumn("probs", softmax(F.col("logits")))
    p = p.withColumn("pmax", F.array_max("probs")).withColumn("pred_internal", argmax(F.col("probs")))
    p = p.withColumn("pred", map_codes(F.col("pred_internal"), TO_EXTERNAL))
    return p.withColumn("tags", abstain(F.col("pred"), F.col("pmax"), thresh))


def lexicon_score(tok: Column, positive: list[str], negative: list[str]) -> tuple[Column, Column, Column]:
    """``(p, n, (p+1)/(p+n+2))`` from whole-token hits of a materialised token array."""
    pos = F.array(*[F.lit(t.lower()) for t in positive])
    neg = F.array(*[F.lit(t.lower()) for t in negative])
    p = F.size(F.filter(tok, lambda x: F.array_contains(pos, x)))
    n = F.size(F.filter(tok, lambda x: F.array_contains(neg, x)))
    return p, n, (p + 1) / (p + n + 2)
