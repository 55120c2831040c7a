"""Language identification with a word-first backoff model.

Spark counts words by language over all training rows, then the character n-grams (1 to 5, with
word edges) of the counted words. The model keeps the ``max_words`` most frequent words and the
``max_grams`` most frequent n-grams of each length, and besides them each language's own most
frequent ones up to its even share of these numbers, so that no language is crowded out; twice the two
bounds size it, whatever the corpus. They bound the model only: the counts cover every training row.
``max_languages`` bounds the third axis; more languages raise an error.

A known word scores by its per-language log frequency. An unseen word is read as overlapping
n-grams of the longest length; where a gram is unknown, the next shorter ones inside it take its
place, and so on down to single characters, each step at a cost. A document's score is the sum over
its words, the answer the language with the largest posterior under equal priors, ties going to the
alphabetically first language.

Words are runs of letters (numbers such as a superscript two are none), lower-cased. Ranking a language's own
items takes its rows from ``SALTS`` sub-keys to one task, at most ``SALTS`` times its share of the bounds. Null texts and texts without a letter get ``und`` and
score 0, as does every text if nothing could be learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import SALTS, by_bytes, give_up_kept, in_python, stored
from corpuslens.session import ship_package

UNDECIDED = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
MAX_WORDS, MAX_GRAMS, MAX_LANGUAGES = 50_000, 20_000, 256
ADD = 0.5  # added to every count
BACKOFF = math.log(0.4)
CACHE_WORDS = 200_000  # unseen words a task remembers before it starts afresh


def letter_runs(text: object) -> list[str]:
    """Runs of letters of a text, lower-cased; null has none."""
    if not isinstance(text, str):
        return []
    words = WORD.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    # numbers that are no decimal digits, such as a superscript two, pass for letters in the pattern
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


def word_counts(labelled: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``labelled(text, lang)``; counted per batch before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "text", 4 << 20):
            for lang, texts in frame.groupby("lang", sort=False)["text"]:
                seen: Counter[str] = Counter()
                for text in texts:
                    seen.update(letter_runs(text))
                yield pd.DataFrame({"lang": lang, "word": list(seen.keys()), "n": list(seen.values())})

    return (in_python(labelled.select("text", "lang"), run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, word (the n-gram), n`` from the counted words; a word's edges are blanks."""
    edged = words.withColumn("_w", F.concat(F.lit(" "), "word", F.lit(" ")))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(LONGEST)),
        lambda k: F.when(F.char_length("_w") >= k, F.transform(
            F.sequence(F.lit(1), F.char_length("_w") - k + 1), lambda i: F.col("_w").substr(i, k))
        ).otherwise(F.array().cast("array<string>"))))
    return (edged.select("lang", "n", F.explode(spans).alias("word")).where("word <> ' '")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _room(table: np.ndarray, rows: int) -> np.ndarray:
    """The table with space for ``rows`` rows, doubled as often as that takes."""
    while len(table) < rows:
        table = np.concatenate([table, np.zeros_like(table)])
    return table


class Table:
    """Smoothed log frequencies by language of named items: one text and one matrix, so that it travels well."""

    def __init__(self, names: list[str], kinds: np.ndarray, counts: np.ndarray, totals: dict[int, np.ndarray]):
        """Among entries of the same kind (words, or grams of one length), and one more for all others, frequencies
        sum to at most 1 in each language, however little text it has. Names have no line breaks."""
        self.names = "\n".join(names)
        self.scores = np.log(counts + ADD)
        for kind in np.unique(kinds):
            own = kinds == kind
            self.scores[own] -= np.log(totals[int(kind)] + ADD * (own.sum() + 1))

    def rows(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.names.split("\n"))} if self.names else {}


class Model:
    """Log frequencies by language of a bounded number of words and n-grams. Lookup tables and caches are built where
    the model is used and do not travel with it."""

    def __init__(self, words: Table, grams: Table, langs: list[str]):
        self.langs, self.words, self.grams = langs, words, grams
        self.row: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "words": self.words, "grams": self.grams, "row": None}

    def _restart(self) -> None:
        """Known words are the first rows of the matrix of scores; unseen ones join them when met."""
        self.row, self.gram_row = self.words.rows(), self.grams.rows()
        self.known = len(self.row)
        self.scores = np.zeros((self.known + 1024, len(self.langs)))
        self.scores[:self.known] = self.words.scores
        self.piece_row: dict[str, int] = {}
        self.piece_scores = np.zeros((1024, len(self.langs)))

    def forget(self) -> None:
        """Lookup tables and caches are given up; the next text builds them again."""
        self.row = None
        self.gram_row, self.piece_row, self.scores, self.piece_scores = {}, {}, None, None

    def _backoff(self, piece: str, depth: int) -> np.ndarray:
        """Log frequency of a piece, or of the shorter pieces in it if it is unknown."""
        known = self.gram_row.get(piece)
        if known is not None:
            return self.grams.scores[known] + BACKOFF * depth
        if len(piece) == 1:
            return np.zeros(len(self.langs))
        return (self._backoff(piece[:-1], depth + 1) + self._backoff(piece[1:], depth + 1)) / 2

    def _pieces(self, word: str) -> list[str]:
        """The longest n-grams of a word with its edges, or all of it if it is shorter."""
        edged = f" {word} "
        return [edged[i:i + LONGEST] for i in range(max(1, len(edged) - LONGEST + 1))]

    def _learn(self, words: list[str]) -> None:
        """Score unseen words: the mean over their pieces, each of which is backed off once and remembered."""
        pieces = [self._pieces(w) for w in words]
        flat = list(chain.from_iterable(pieces))
        new = list(set(flat).difference(self.piece_row))
        self.piece_scores = _room(self.piece_scores, len(self.piece_row) + len(new))
        for piece in new:
            self.piece_scores[len(self.piece_row)] = self._backoff(piece, 0)
            self.piece_row[piece] = len(self.piece_row)
        sizes = np.array([len(p) for p in pieces])
        rows = np.fromiter(map(self.piece_row.__getitem__, flat), dtype=np.int64, count=len(flat))
        sums = np.add.reduceat(self.piece_scores[rows], np.cumsum(sizes) - sizes, axis=0)
        first = len(self.row)
        self.scores = _room(self.scores, first + len(words))
        self.scores[first:first + len(words)] = sums / sizes[:, None]
        self.row.update(zip(words, range(first, first + len(words))))

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of a batch of texts."""
        words = [letter_runs(t) if self.langs else [] for t in texts]
        flat = list(chain.from_iterable(words))
        if self.row is None or len(self.row) > self.known + CACHE_WORDS:
            self._restart()
        if new := sorted(set(flat).difference(self.row)):
            self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        some = sizes > 0
        names, best = [UNDECIDED] * len(texts), np.zeros(len(texts))
        if some.any():
            first = (np.cumsum(sizes) - sizes)[some]
            total = np.add.reduceat(self.scores[rows], first, axis=0)
            top = total.argmax(axis=1)
            best[some] = 1.0 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
            for i, k in zip(np.flatnonzero(some), top):
                names[i] = self.langs[k]
        return names, best


def _own_largest(counts: DataFrame, most: int) -> DataFrame:
    """``kind, word`` of each language's ``most`` items with the largest counts; ranked within sub-keys first, so
    that one task gets at most ``SALTS`` * ``most`` rows of a language."""
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    for keys in (["kind", "lang", "_salt"], ["kind", "lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
        salted = salted.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    return salted.select("kind", "word")


def _largest(counts: DataFrame, kind, most: int, langs: list[str]) -> Table:
    """The ``most`` items with the largest counts of each kind, and each language's own ``most`` / languages; one
    row an item, with its counts in all languages."""
    counts = counts.withColumn("kind", kind)
    place = {lang: i for i, lang in enumerate(langs)}
    totals: dict[int, np.ndarray] = {}  # a row per kind (1 for words, at most LONGEST for grams) and language
    for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("total")).collect():
        totals.setdefault(r.kind, np.zeros(len(langs)))[place[r.lang]] = r.total
    if not totals:
        return Table([], np.empty(0, np.int64), np.empty((0, len(langs))), {})
    items = counts.groupBy("kind", "word").agg(F.sum("n").alias("_all"))
    top = _own_largest(counts, max(most // max(len(langs), 1), 1))
    for k in totals:
        top = top.unionByName(items.where(F.col("kind") == k).orderBy(F.desc("_all"), "word").limit(most).select("kind", "word"))
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    rows = (counts.join(top.distinct(), ["kind", "word"]).groupBy("kind", "word").agg(by_lang.alias("m"))
            .select("kind", "word", F.transform(F.array(*[F.lit(x) for x in langs]),
                                                lambda x: F.coalesce(F.col("m")[x], F.lit(0).cast("long"))).alias("n")))
    got = rows.orderBy("kind", "word").toArrow()
    counted = got["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
    return Table(got["word"].to_pylist(), got["kind"].to_numpy(), counted, totals)


def fit(labelled: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from ``labelled(text, lang)``. At most twice ``max_words + 5 * max_grams`` items reach the driver."""
    words = stored(word_counts(labelled.where("lang is not null")), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # dealt by word: the counted words are a small table whose few files would be as few tasks
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = stored(gram_counts(words.repartition(parts, "word")), "grams")
    return Model(_largest(words, F.lit(0), max_words, langs), _largest(grams, F.char_length("word"), max_grams, langs), langs)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (both replaced if there)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_up_kept()
        own = shared.value
        try:
            for part in texts:
                for piece in by_bytes(iter([part.to_frame("text")]), "text"):
                    names, scores = own.predict(piece["text"].tolist())
                    yield pd.DataFrame({"lang_pred": names, "score": scores})
        finally:  # the worker and its broadcast values outlive the task
            own.forget()

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return (docs.select(*keep, judge(F.col(text).cast("string")).alias("_judged"))
            .select(*keep, F.col("_judged.lang_pred"), F.col("_judged.score")))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with a language whose CRC-32 of the id as text leaves a remainder other than 2 by 4."""
    return docs.where("lang is not null").where(~held_out()).select("text", "lang")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``; a null id is not held out."""
    judged = predict(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def filter_language(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Rows in one of ``languages`` (default: any learned one) with a posterior of ``least`` or more."""
    judged = predict(docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns}), fit(training_rows(docs)),
                     "_kept_text")
    good = judged.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least))
    if languages is not None:
        good = good.where(F.col("lang_pred").isin(languages))
    return good.select(*[F.col(f"_kept_{c}").alias(c) for c in docs.columns])
