"""Repeated passages: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A word goes when a window that covers it also starts in a document with a smaller id. Windows are
judged on the input. The kept words of the document are joined by one space.

Shuffling a row for every window would move many times the corpus, so windows are counted behind
two steps that lose none:

* Documents with the same word sequence (128-bit hash) are judged through the one with the smallest
  id; of the others every word goes if they have a whole window.
* Each window names an anchor: the smallest (width / 2)-word gram hash in it (winnowing; about one
  gram in thirteen is anchor of some window). Equal windows name the same anchor, so only windows
  whose anchor occurs in two documents can repeat. Anchors are counted first, and only documents
  with a shared anchor are read again for the hashes of just those windows.

Window hashes have 64 bits: with N counted windows a window is taken for another with a probability
of about N / 2**64. Window starts that follow one another merge into maximal removal intervals.

Null and empty texts have no words. Rows that share an id count as one document for the rule
"smaller id" and are cut each on its own; rows with a null id keep all words and take none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SALTS, as_bytes, by_bytes, in_python, stored, with_group_stats
from corpuslens.llm.tokens import U64, mix, numbers, window_hashes, word_hashes
from corpuslens.operators.joins import salted_join

WIDTH = 50
HOT = 256  # rows of one hash from which its joins are dealt over sub-keys


def window_anchors(words: np.ndarray, width: int) -> np.ndarray:
    """For every window the smallest gram hash in it."""
    gram = max(width // 2, 1)
    grams = window_hashes(words, gram)
    span = width - gram + 1  # grams in a window
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, U64)
    low, have = grams, 1  # sliding minimum by doubling
    while have * 2 <= span:
        low = np.minimum(low[:len(low) - have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[span - have:span - have + n])


def _sequence_key(words: np.ndarray) -> tuple[int, int]:
    place = numbers(21, 1)[0] * np.arange(1, len(words) + 1, dtype=U64)
    one, two = mix(words + place), mix(words ^ mix(place))
    return int(one.sum(dtype=U64).view(np.int64)), int(two.sum(dtype=U64).view(np.int64))


def scan(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs(id, t, text)``: word count, sequence keys, the SHA-256 of all words
    joined by one space, and the distinct anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text"):
            raw = [as_bytes(t) for t in frame["text"]]
            words, at = word_hashes(raw)
            each = [words[at[i]:at[i + 1]] for i in range(len(raw))]
            keys = [_sequence_key(w) for w in each]
            yield pd.DataFrame({
                "id": frame["id"], "t": frame["t"], "n_words": [len(w) for w in each],
                "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                "sha": [hashlib.sha256(b" ".join(r.split())).hexdigest() for r in raw],
                "anchors": [np.unique(window_anchors(w, width)).view(np.int64) for w in each],
            })

    return in_python(docs, run, "id long, t long, n_words long, k1 long, k2 long, sha string, anchors array<long>")


def shared_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``h, id, t, pos`` of each window of ``docs(id, t, text, anchors)`` that names one of the anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text"):
            words, at = word_hashes([as_bytes(t) for t in frame["text"]])
            hashes, places, rows = [], [], []
            for i, wanted in enumerate(frame["anchors"]):
                own = words[at[i]:at[i + 1]]
                pos = np.flatnonzero(np.isin(window_anchors(own, width), np.asarray(wanted, dtype=np.int64).view(U64)))
                hashes.append(window_hashes(own, width)[pos].view(np.int64))
                places.append(pos.astype(np.int32))
                rows.append(np.full(len(pos), i))
            if rows:
                row = np.concatenate(rows)
                yield pd.DataFrame({"h": np.concatenate(hashes), "id": frame["id"].to_numpy()[row],
                                    "t": frame["t"].to_numpy()[row], "pos": np.concatenate(places)})

    return in_python(docs, run, "h long, id long, t long, pos int")


def cut_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(id, t, text, starts)`` without the words of the windows that begin at ``starts``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text"):
            out = []
            for doc, t, text, starts in zip(frame["id"], frame["t"], frame["text"], frame["starts"]):
                words = as_bytes(text).split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.asarray(starts, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((doc, t, int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "replace"), turn.reshape(-1, 2).tolist()))
            yield pd.DataFrame(out, columns=["rep", "rep_t", "n_removed", "kept_sha256", "kept_text", "spans"])

    return in_python(docs, run, "rep long, rep_t long, n_removed long, kept_sha256 string, kept_text string, "
                                 "spans array<array<int>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` (null where
    nothing goes: the text's words as they are) and ``spans`` ([start, end) words that go; null likewise)."""
    # t tells apart different texts of rows that share an id
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")
                         ).withColumn("t", F.xxhash64("text"))
    seen = stored(scan(source, width), "scan")
    known = seen.where("id is not null")
    same = with_group_stats(known.select("id", "t", "n_words", "k1", "k2", "sha"), ["k1", "k2", "n_words"],
                            {"rep": ("min", "id")}, F.xxhash64("id"))
    same = stored(same, "same")
    reps = same.where("id = rep").groupBy("id", "k1", "k2").agg(F.min("t").alias("t"))

    anchored = (known.select("id", "t", F.explode("anchors").alias("anchor"))
                .join(reps.select("id", "t"), ["id", "t"], "left_semi").distinct())
    anchored = stored(anchored, "anchors")
    shared = (anchored.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m"))
              .where("lo < hi").select("anchor", "m"))
    hot = shared.where(F.col("m") > HOT).select("anchor")
    wanted = salted_join(anchored, shared.select("anchor"), ["anchor"], hot, SALTS, F.xxhash64("id", "t"))
    wanted = wanted.groupBy("id", "t").agg(F.collect_list("anchor").alias("anchors"))
    texts = stored(source.join(wanted, ["id", "t"]).dropDuplicates(["id", "t"]), "anchored")

    windows = stored(shared_windows(texts, width), "windows")
    first = (windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m"))
             .where("lo < hi").select("h", "lo", "m"))
    hot = first.where(F.col("m") > HOT).select("h")
    later = salted_join(windows, first.select("h", "lo"), ["h"], hot, SALTS, F.xxhash64("id", "t")).where("lo < id")
    starts = later.groupBy("id", "t").agg(F.collect_set("pos").alias("starts"))
    cut = cut_words(texts.select("id", "t", "text").join(starts, ["id", "t"]), width)

    # the row of the smallest id is cut by its windows; a copy of it loses all words, if it has a window, and needs no
    # join, so a group of copies is in no one's way
    best = reps.select("id", "k1", "k2", F.col("t").alias("rep_t"))
    cut = cut.withColumnRenamed("rep", "id")
    part = F.col("n_removed").isNotNull()
    own = same.where("id = rep").join(best, ["id", "k1", "k2"]).join(cut, ["id", "rep_t"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.when(part, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(part, F.col("kept_text")).alias("kept_text"), F.when(part, F.col("spans")).alias("spans"))
    whole = F.col("n_words") >= width
    copies = same.where("id <> rep").select(
        "id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).alias("kept_text"),
        F.when(whole, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).alias("spans"))
    found = own.unionByName(copies)
    rest = seen.where("id is null").select(
        "id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"), F.lit(None).cast("array<array<int>>").alias("spans"))
    return found.unionByName(rest).withColumnRenamed("id", id_col)
