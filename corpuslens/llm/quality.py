"""Quality classifier without hand labels: a weak-label model and a hashed linear scorer.

1. Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on every document.
2. Spark counts the documents of each vote pattern; there are at most 3 ** labellers patterns, whatever
   the corpus. Expectation-maximisation on these counts estimates, per labeller, how often it votes what on good
   and on bad documents, and gives each pattern a posterior.
3. The posteriors are the targets of a logistic scorer over hashed words, word shapes and repeats. It is
   fitted on a bounded sample, the ``sample`` documents with the smallest hash of (id, text). Their
   features are hashed in Spark tasks; only buckets and shares reach the driver, no text.
4. Every whole text is scored by the fitted weights; a document stays if its score is ``least`` or more.

Null and wordless texts get score 0 and do not stay. Rows that repeat an id are scored each on its
own. With no documents to learn from the scorer answers 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import as_bytes, by_bytes, in_python, stored
from corpuslens.llm.tokens import U64, mix, numbers, word_hashes

BITS = 16
SAMPLE, EPOCHS, LEAST = 8_000, 12, 0.5
LABELLERS = ("repeats", "streaks", "symbols", "marks", "marked", "letterless", "capitals", "shouts", "variety", "sentences",
             "word_length", "lines", "length")
_MARKS = re.compile(rb"([!-/:-@\[-`{-~])\1(?=[ \t-\r]|\Z)")  # a word that ends in a doubled mark
_ODD = re.compile(rb"[#$%&*|~^<>{}\[\]=\\!][#$%&*|~^<>{}\[\]=\\!]*")
_LETTERLESS = re.compile(rb"(?<![^ \t-\r])[!-@\[-`{-~]+(?=[ \t-\r]|\Z)")

_SHAPE = np.arange(256, dtype=np.uint8)  # bytes to classes: letters and digits fold, marks stay
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_SHAPE = _SHAPE.tobytes()
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#$%&*|~^<>{}[]=\\_@", dtype=np.uint8)] = True


def _vote(value: float, good, bad) -> int:
    return 1 if good(value) else -1 if bad(value) else 0


def votes(raw: bytes, words: np.ndarray) -> list[int]:
    """The labellers' votes on one text with its word hashes; see ``LABELLERS`` for the order."""
    n = len(words)
    if n == 0:
        return [0] * (len(LABELLERS) - 1) + [-1]
    data = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum()) + int((data >= 128).sum()) // 2
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    variety = len(np.unique(words)) / min(n, 200)
    streak = float((words[2:] == words[:-2]).mean()) if n > 2 else 0.0
    return [
        _vote(repeated, lambda v: v < 0.05, lambda v: v > 0.15),
        _vote(streak, lambda v: v < 0.05, lambda v: v > 0.2),
        _vote(float(_SYMBOL[data].mean()), lambda v: v < 0.005, lambda v: v > 0.02),
        _vote(len(_MARKS.findall(raw)) / n, lambda v: v < 0.02, lambda v: v > 0.2),
        _vote(len(_ODD.findall(raw)) / n, lambda v: v < 0.05, lambda v: v > 0.2),
        _vote(len(_LETTERLESS.findall(raw)) / n, lambda v: v < 0.1, lambda v: v > 0.2),
        _vote(upper / max(upper + lower, 1), lambda v: v < 0.2, lambda v: v > 0.5),
        _vote(raw.count(b"!") / n, lambda v: v < 0.1, lambda v: v > 0.3),
        _vote(variety, lambda v: v > 0.4, lambda v: v < 0.2) if n >= 30 else 0,
        _vote(stops / n, lambda v: 0.01 <= v <= 0.4, lambda v: v < 0.003 or v > 0.6) if n >= 30 else 0,
        _vote(len(raw) / n, lambda v: 3 <= v <= 14, lambda v: v < 2.5 or v > 25),
        _vote(len(set(lines)) / len(lines), lambda v: v > 0.8, lambda v: v < 0.5) if len(lines) >= 4 else 0,
        1 if n >= 20 else -1 if n < 3 else 0,
    ]


def features(raws: list[bytes], words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of every word and of every word's shape (with a mark if it repeats the last word)."""
    shapes, _ = word_hashes([r.translate(_SHAPE) for r in raws])
    repeat = np.zeros(len(words), dtype=U64)
    if len(words) > 1:
        repeat[1:] = words[1:] == words[:-1]
    inner = at[:-1][(at[:-1] > 0) & (at[:-1] < len(words))]
    repeat[inner] = 0  # a text's first word repeats nothing
    shapes = mix(shapes * numbers(31, 1)[0] + repeat)
    mask = U64((1 << BITS) - 1)
    return (words & mask).astype(np.int64), (shapes & mask).astype(np.int64)


def _scores(weights: np.ndarray, raws: list[bytes]) -> np.ndarray:
    words, at = word_hashes(raws)
    if len(words) == 0:
        return np.zeros(len(raws))
    one, two = features(raws, words, at)
    total = np.concatenate([[0.0], np.cumsum(weights[one] + weights[(1 << BITS) + two])])
    n = np.diff(at)
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(mean + weights[-1], -30, 30))), 0.0)


def vote_table(docs: DataFrame) -> DataFrame:
    """``key, pattern`` (votes as digits 0 bad, 1 nothing, 2 good) of ``docs(key, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text"):
            raws = [as_bytes(t) for t in frame["text"]]
            words, at = word_hashes(raws)
            yield pd.DataFrame({"key": frame["key"], "pattern": [
                "".join(str(v + 1) for v in votes(r, words[at[i]:at[i + 1]])) for i, r in enumerate(raws)]})

    return in_python(docs, run, "key long, pattern string")


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over counted vote patterns: posterior of good by pattern, and the
    chance of each vote, if one is cast, by class and labeller. The first guess is the share of good votes."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], dtype=float)
    seen = np.array([[int(c) for c in p] for p in names])
    hot = (seen[:, :, None] == np.arange(3)) * (np.arange(3) != 1)  # pattern, labeller, vote; no vote tells nothing
    good, bad = (seen == 2).sum(1), (seen == 0).sum(1)
    post = np.where(bad > 0, 0.5 * good / np.maximum(good + 3 * bad, 1), 0.95)
    for _ in range(rounds):
        by_class = np.stack([1 - post, post]) * n  # class, pattern
        chance = np.einsum("cp,plv->clv", by_class, hot) + 1.0
        chance[:, :, 1] = 0.0
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (by_class.sum(1) + 1) / (n.sum() + 2)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", hot, np.log(np.maximum(chance, 1e-12)))
        fresh = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved, post = np.abs(fresh - post).max(), fresh
        if moved < 1e-9:
            break
    return dict(zip(names, post.tolist())), chance


def sparse_features(raw: bytes) -> tuple[bytes, bytes]:
    """A text's buckets (int32) and their shares of its words (float32), both empty without words."""
    words, at = word_hashes([raw])
    if len(words) == 0:
        return b"", b""
    one, two = features([raw], words, at)
    cells, counts = np.unique(np.concatenate([one, (1 << BITS) + two]), return_counts=True)
    return (np.append(cells, 2 << BITS).astype(np.int32).tobytes(),
            np.append(counts / len(words), 1.0).astype(np.float32).tobytes())


def training_rows(docs: DataFrame) -> DataFrame:
    """``key, cells, shares, weak_label`` of ``docs(key, text, weak_label)``, hashed one text at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text"):
            made = [sparse_features(as_bytes(t)) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "cells": [m[0] for m in made], "shares": [m[1] for m in made],
                                "weak_label": frame["weak_label"]})

    return in_python(docs, run, "key long, cells binary, shares binary, weak_label double")


def train(rows: list[tuple[bytes, bytes, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Logistic weights (words, shapes, bias) by AdaGrad over ``(cells, shares, target)`` rows."""
    weights = np.zeros((2 << BITS) + 1)
    known = [(np.frombuffer(cells, dtype=np.int32), np.frombuffer(shares, dtype=np.float32), target)
             for cells, shares, target in rows if cells]
    speed = np.full(len(weights), 1e-8)
    order = np.random.default_rng(7).permutation(len(known))
    for _ in range(epochs):
        for cells, share, target in (known[i] for i in order):
            guess = 1 / (1 + np.exp(-np.clip(weights[cells] @ share, -30, 30)))
            step = (guess - target) * share
            speed[cells] += step * step
            weights[cells] -= 0.5 * step / np.sqrt(speed[cells])
    return weights


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE,
            least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, ``weak_label`` (posterior), ``score`` and ``kept``."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text)).alias("key"),
                         F.col(text).cast("string").alias("text"))
    voted = stored(vote_table(source.select("key", "text")), "votes")
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = estimate(counts) if counts else ({}, None)
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "pattern string, weak_label double")
    labelled = voted.join(F.broadcast(table), "pattern")  # at most 3 ** len(LABELLERS) patterns
    chosen = labelled.select("key", "weak_label").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    picked = source.join(F.broadcast(chosen), "key").where("text is not null").select("key", "text", "weak_label")
    rows = training_rows(picked).dropDuplicates(["key"]).orderBy("key").collect()  # at most ``sample``, no texts
    weights = train([(bytes(r.cells), bytes(r.shares), r.weak_label) for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** (BITS + 1) + 1 numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in by_bytes(frames, "text"):
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"], "score": _scores(own, [as_bytes(t) for t in frame["text"]])})

    scored = in_python(source.withColumn("id", F.col("id").cast("string")), run, "id string, key long, score double")
    return (scored.join(labelled.select("key", "weak_label").distinct(), "key")
            .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "weak_label", "score",
                    (F.col("score") >= least).alias("kept")))
