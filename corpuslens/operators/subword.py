"""Subword statistics, byte-pair merges and fixed-vocabulary encoding.

Merges are learned in exactly the order of a learner that makes one at a time: the most frequent pair first,
of equal ones the lexicographically smallest. The words stay in Spark, as rows of symbol numbers. The driver holds the
counts of the most frequent pairs and a bounded number of frequent words, and guesses by these a run of merges. One job makes
them on all words and returns by how much each one changes which counts. The driver then takes the guessed merges for
as long as the next one is the best pair by the exact counts; the first always is. Pairs that are not held come
no earlier than the last pair held when the counts were read; where that proves nothing, they are read again.

Texts are encoded by joining their words to a table of segmented distinct words; Python sees each distinct
word once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import SPACE
from corpuslens.operators.joins import salted_join
from corpuslens.session import ensure_checkpoint_dir, ship_package
from corpuslens.sources.sinks import written

# Word-boundary marker, pad and unknown ids.
BOUNDARY = "▁"
PAD_ID, UNK_ID = 0, 1


def word_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over whitespace-split words of (already normalised) texts."""
    w = texts.select(F.explode_outer(F.split(F.col(text_col), " ")).alias("word"))
    return w.where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def alphabet_of(words: DataFrame) -> list[str]:
    """The different symbols of ``words(word)``, the boundary marker among them where there are words."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for f in frames:
            seen.update(BOUNDARY if len(f) else "", *f["word"])
        if seen:
            yield pd.DataFrame({"s": np.array(list(seen), dtype=object)})

    ship_package(words.sparkSession)
    return sorted(r["s"] for r in words.select("word").mapInPandas(run, "s string").distinct().collect())


def symbols(word: Column) -> Column:
    """Boundary marker followed by the word's characters (code points)."""
    m = F.concat(F.lit(BOUNDARY), word)
    return F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.substring(m, i, 1))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent-symbol pair counts weighted by word frequency; ``words`` has ``sym`` and ``n``."""
    sym = F.col("sym")
    size = F.size(sym)
    z = F.slice(F.arrays_zip(sym.alias("a"), F.slice(sym, 2, F.greatest(size, F.lit(1))).alias("b")),
                1, F.greatest(size - 1, F.lit(0)))
    p = words.select("n", F.explode_outer(z).alias("p"))
    return p.where(F.col("p").isNotNull()).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")) \
        .agg(F.sum("n").alias("n"))


def apply_merge(sym: Column, a: str, b: str) -> Column:
    """Left-to-right, non-overlapping replacement of adjacent ``a b`` by ``ab``."""
    la, lb, ab = F.lit(a), F.lit(b), F.lit(a + b)

    def step(acc, x):
        last = F.element_at(acc, -1)
        merge = (F.size(acc) > 0) & (last == la) & (x == lb)
        return F.when(merge, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(ab))) \
            .otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(sym, F.array().cast("array<string>"), step)


def merge_word(sym: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the leftmost pair of the lowest rank until no adjacent pair has a rank."""
    sym = list(sym)
    while len(sym) > 1:
        best, i = min((ranks.get((sym[i], sym[i + 1]), 1 << 30), i) for i in range(len(sym) - 1))
        if best == 1 << 30:
            break
        sym[i:i + 2] = [sym[i] + sym[i + 1]]
    return sym


def replay(sym: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Make merges one after the other in the order of their ranks, each from left to right."""
    done = -1
    while True:
        there = [r for p in zip(sym, sym[1:]) if (r := ranks.get(p, -1)) > done]
        if not there:
            return sym
        done = min(there)
        a, b = next(p for p in zip(sym, sym[1:]) if ranks.get(p) == done)
        sym = _joined(sym, a, b)


def _joined(sym: list[str], a: str, b: str) -> list[str]:
    out, i = [], 0
    while i < len(sym):
        if i + 1 < len(sym) and sym[i] == a and sym[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(sym[i])
            i += 1
    return out


def pieces(sym: list[str], wanted: set[tuple[str, str]], around: int) -> list[tuple[list[str], bool, bool]]:
    """The stretches of a word that hold wanted pairs, with ``around`` more symbols on either side, and whether
    each is cut off on its left and on its right. No adjacency lies in two stretches."""
    ranges: list[list[int]] = []
    for i, pair in enumerate(zip(sym, sym[1:])):
        if pair in wanted:
            lo, hi = max(i - around, 0), min(i + 2 + around, len(sym))
            if ranges and lo < ranges[-1][1]:
                ranges[-1][1] = hi
            else:
                ranges.append([lo, hi])
    return [(sym[lo:hi], lo > 0, hi < len(sym)) for lo, hi in ranges]


def merge_round(found: list[tuple[list[str], bool, bool, int]], wanted: dict[tuple[str, str], int],
                beyond: tuple | None, symbols_before: set[str], most: int) -> list[tuple[str, str, int]]:
    """The next merges that the pieces prove, in order: at least one, at most until ``most`` different symbols that
    were not in ``symbols_before`` are made. ``beyond`` is (-count, a, b) of the best pair that was not wanted."""
    words = [list(f[0]) for f in found]
    counts: dict[tuple[str, str], int] = {}
    places: dict[tuple[str, str], set[int]] = {}
    fresh: set[str] = set()

    def known(pair: tuple[str, str]) -> bool:
        return pair in wanted or pair[0] in fresh or pair[1] in fresh

    def add(i: int, sign: int) -> set[tuple[str, str]]:
        changed = {p for p in zip(words[i], words[i][1:]) if known(p)}
        for p in zip(words[i], words[i][1:]):
            if p in changed:
                counts[p] = counts.get(p, 0) + sign * found[i][3]
        for p in changed:
            places.setdefault(p, set()).add(i) if sign > 0 else places[p].discard(i)
        return changed

    for i in range(len(words)):
        add(i, 1)
    heap = [(-n, *p) for p, n in counts.items()]
    heapq.heapify(heap)
    made: list[tuple[str, str, int]] = []
    while heap and len(fresh) < most:
        key = heapq.heappop(heap)
        a, b = key[1:]
        if counts.get((a, b), 0) != -key[0]:
            continue  # an older count
        if made and beyond is not None and key >= beyond:
            break
        made.append((a, b, -key[0]))
        old = a + b in symbols_before or a + b in fresh  # made on another way
        cut, changed = False, set()
        if not old:
            fresh.add(a + b)
        for i in list(places[a, b]):
            sym = words[i]
            cut = cut or found[i][1] and (sym[0], sym[1]) == (a, b) or found[i][2] and (sym[-2], sym[-1]) == (a, b)
            changed |= add(i, -1)
            words[i] = _joined(sym, a, b)
            changed |= add(i, 1)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], *p))
        if cut or old:
            break
    return made


class Stretch:
    """Words as one array of symbol numbers with 0 between them and a weight per place; merges change it in place in
    time of their occurrences. Only pairs in ``wanted`` (codes) are indexed; without it a merge looks through all."""

    def __init__(self, sym: np.ndarray, weight: np.ndarray, wanted: np.ndarray | None = None):
        self.sym, self.weight = sym.copy(), weight
        at = np.arange(len(sym), dtype=np.int32)
        self.nxt, self.prv = np.minimum(at + 1, len(sym) - 1), np.maximum(at - 1, 0)
        self.wanted = None if wanted is None else np.unique(wanted)
        self.places: dict[int, list[np.ndarray]] = {}
        if wanted is not None and len(wanted):
            top = max(int(sym.max(initial=0)), int(self.wanted.max() >> SHIFT), int((self.wanted & MASK).max())) + 1
            left, right = np.zeros(top, bool), np.zeros(top, bool)
            left[self.wanted >> SHIFT], right[self.wanted & MASK] = True, True
            self._index(np.flatnonzero(left[sym[:-1]] & right[sym[1:]]).astype(np.int32))

    def copy(self) -> Stretch:
        other = Stretch.__new__(Stretch)
        other.sym, other.nxt, other.prv = self.sym.copy(), self.nxt.copy(), self.prv.copy()
        other.weight, other.wanted, other.places = self.weight, self.wanted, {c: list(x) for c, x in self.places.items()}
        return other

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return (self.sym[at].astype(np.int64) << SHIFT) | self.sym[self.nxt[at]]

    def _index(self, at: np.ndarray) -> None:
        codes = self._codes(at)
        spot = np.minimum(np.searchsorted(self.wanted, codes), len(self.wanted) - 1)
        there = self.wanted[spot] == codes
        at, spot = at[there], spot[there]
        order = np.argsort(spot, kind="stable")
        at, spot = at[order], spot[order]
        starts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(spot) else []
        for lo, hi in zip(starts, [*starts[1:], len(spot)]):
            self.places.setdefault(int(self.wanted[spot[lo]]), []).append(at[lo:hi])

    def merge(self, a: int, b: int, ab: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges ``a b`` from left to right; the codes of the pairs whose counts change, and by how much."""
        if self.wanted is None:
            at = np.flatnonzero(self.sym == a).astype(np.int32)
        else:
            found = self.places.pop((a << SHIFT) | b, [])
            at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)
        at = at[(self.sym[at] == a) & (self.sym[self.nxt[at]] == b)]
        if a == b and len(at):  # of a run every other one
            i = np.arange(len(at))
            start = np.r_[True, self.nxt[at[:-1]] != at[1:]]
            at = at[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        second = self.nxt[at]
        lost = np.unique(np.concatenate([self.prv[at], at, second]))
        codes, sums = [self._codes(lost)], [-self._weights(lost)]
        after = self.nxt[second]
        self.sym[at], self.sym[second] = ab, GONE
        self.nxt[at], self.prv[after] = after, at
        won = np.unique(np.concatenate([self.prv[at], at]))
        codes.append(self._codes(won))
        sums.append(self._weights(won))
        if self.wanted is not None:
            self._index(won)
        return summed(np.concatenate(codes), np.concatenate(sums))

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return np.where((self.sym[at] > 0) & (self.sym[self.nxt[at]] > 0), self.weight[at], 0)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and weights of the words that still have a pair."""
        keep = self.sym != GONE
        sym, weight = self.sym[keep], self.weight[keep]
        word = np.cumsum(sym == 0)
        long = np.bincount(word, minlength=1)[word] > 2  # its symbols and the 0 before them
        return np.append(sym[long], np.int32(0)), np.append(weight[long], 0)


SHIFT, MASK, GONE = 21, (1 << 21) - 1, -1  # a pair's code is left symbol << SHIFT | right symbol


def summed(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums, without those that add up to nothing."""
    if not len(codes):
        return codes, sums
    order = np.argsort(codes, kind="stable")
    codes, sums = codes[order], sums[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    codes, sums = codes[starts], np.add.reduceat(sums, starts)
    return codes[sums != 0], sums[sums != 0]


PAIRS, SAMPLE = 200_000, 50_000  # most frequent pairs counted and most frequent words held by the driver
FIRST_GUESSES, GUESSES = 32, 256  # merges tried in the first round and in any round
REPLAYED = 256  # merges after which the words are written anew
ROW_WORDS = 200_000  # words in a row of the stored words at most
_STATE = "sym binary, weight binary"


def _packed(words: list[str], counts: list[int], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    sym, weight = [], []
    for word, n in zip(words, counts):
        sym += [0, numbers[BOUNDARY], *map(numbers.__getitem__, word)]
        weight += [n] * (len(word) + 2)
    return np.array([*sym, 0], dtype=np.int32), np.array([*weight, 0], dtype=np.int64)


def _state(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for sym, weight in zip(batch["sym"], batch["weight"]):
        yield np.frombuffer(sym, np.int32), np.frombuffer(weight, np.int64)


def _store(words: DataFrame, numbers: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def row() -> pd.DataFrame:
            sym, weight = (np.concatenate(x) for x in zip(*held))
            return pd.DataFrame({"sym": [sym.tobytes()], "weight": [weight.tobytes()]})

        for batch in batches:
            held.append(_packed(list(batch["word"]), list(batch["n"]), numbers))
            many += len(batch)
            if many >= ROW_WORDS:
                yield row()
                held, many = [], 0
        if held:
            yield row()

    return written(words.select("word", "n").mapInPandas(run, _STATE), "bpe")


def _replayed(state: DataFrame, done: list[tuple[int, int, int]]) -> DataFrame:
    """The stored words after these merges."""
    wanted = np.array([(a << SHIFT) | b for a, b, _ in done], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sym, weight in _state(batch):
                stretch = Stretch(sym, weight, wanted)
                for m in done:
                    stretch.merge(*m)
                sym, weight = stretch.left()
                yield pd.DataFrame({"sym": [sym.tobytes()], "weight": [weight.tobytes()]})

    return written(state.mapInPandas(run, _STATE), "bpe")


def _changes(state: DataFrame, done: list[tuple[int, int, int]], tried: list[tuple[int, int, int]]) -> list[dict[int, int]]:
    """By how much each tried merge, made after ``done`` and those before it, changes which pairs' counts."""
    wanted = np.array([(a << SHIFT) | b for a, b, _ in done + tried], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[list] = [[] for _ in tried]
        for batch in batches:
            for sym, weight in _state(batch):
                stretch = Stretch(sym, weight, wanted)
                for m in done:
                    stretch.merge(*m)
                for i, m in enumerate(tried):
                    found[i].append(stretch.merge(*m))
        for i, parts in enumerate(found):
            if parts:
                codes, sums = summed(*(np.concatenate(x) for x in zip(*parts)))
                if len(codes):
                    yield pd.DataFrame({"step": [i], "codes": [codes.tobytes()], "sums": [sums.tobytes()]})

    out: list[dict[int, int]] = [{} for _ in tried]
    for r in state.mapInPandas(run, "step int, codes binary, sums binary").collect():
        step = out[r.step]
        for c, n in zip(np.frombuffer(r.codes, np.int64).tolist(), np.frombuffer(r.sums, np.int64).tolist()):
            step[c] = step.get(c, 0) + n
    return out


def _ranked(state: DataFrame, names: list[str], most: int) -> list[tuple[int, str, str, int]]:
    """(-count, a, b, code) of the ``most`` best pairs in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sym, weight in _state(batch):
                both = (sym[:-1] > 0) & (sym[1:] > 0)
                codes, sums = summed((sym[:-1].astype(np.int64)[both] << SHIFT) | sym[1:][both], weight[:-1][both])
                yield pd.DataFrame({"code": codes, "n": sums})

    counts = state.mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = state.sparkSession.createDataFrame(pd.DataFrame({"id": range(len(names)), "name": names}), "id long, name string")
    a = F.broadcast(table.withColumnsRenamed({"id": "ia", "name": "a"}))  # characters and merged symbols
    b = F.broadcast(table.withColumnsRenamed({"id": "ib", "name": "b"}))
    named = (counts.withColumns({"ia": F.shiftright("code", SHIFT), "ib": F.col("code").bitwiseAND(F.lit(MASK))})
             .join(a, "ia").join(b, "ib").select("n", "a", "b", "code"))
    return [(-r.n, r.a, r.b, r.code) for r in named.orderBy(F.col("n").desc(), "a", "b").limit(most).collect()]


class _Counts:
    """Counts of the best pairs, and the best of them in order."""

    def __init__(self, ranked: list[tuple[int, str, str, int]], most: int, names: list[str], old: set[int]):
        self.names, self.old = names, old  # pairs of symbols made later than these are all held
        self.beyond = ranked[most] if len(ranked) > most else None  # all pairs that are not held come no earlier
        self.heap = ranked[:most]
        self.n = {code: -n for n, _, _, code in self.heap}
        self.more: dict[int, int] = {}  # what pairs not held have won
        self.won = 0  # the largest of these
        heapq.heapify(self.heap)

    def key(self, code: int, n: int) -> tuple[int, str, str, int]:
        return -n, self.names[code >> SHIFT], self.names[code & MASK], code

    def best(self) -> tuple[int, str, str, int] | None:
        while self.heap and self.n.get(self.heap[0][3], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def proven(self, best: tuple[int, str, str, int]) -> bool:
        if self.beyond is None:
            return True
        return best[:3] < self.beyond[:3] if not self.won else best[0] < self.beyond[0] - self.won

    def change(self, deltas: dict[int, int]) -> None:
        for code, d in deltas.items():
            if self.beyond is None or code in self.n or not {code >> SHIFT, code & MASK} <= self.old:
                self.n[code] = n = self.n.get(code, 0) + d
                if n > 0:
                    heapq.heappush(self.heap, self.key(code, n))
            else:
                self.more[code] = self.more.get(code, 0) + d
                self.won = max(self.won, self.more[code])

    def guess(self, sample: Stretch, number, most: int) -> list[tuple[int, int, int]]:
        """Merges likely to come next, the first one certain: made on a copy of the sample, whose changes are
        scaled to the counts."""
        sample, aside, likely, own, out = sample.copy(), [], {}, [], []
        while len(out) < most:
            best = self.best()
            while best is not None and best[3] in likely:
                aside.append(heapq.heappop(self.heap))
                best = self.best()
            while own and likely[own[0][3]] != -own[0][0]:
                heapq.heappop(own)
            if own and (best is None or own[0] < best):
                best = own[0]
            if best is None:
                break
            a, b = best[3] >> SHIFT, best[3] & MASK
            out.append((a, b, number(a, b)))
            codes, sums = sample.merge(*out[-1])
            change = dict(zip(codes.tolist(), sums.tolist()))
            seen = -change.pop(best[3], 0)
            likely[best[3]] = 0
            for code, d in change.items():
                n = round(likely.get(code, self.n.get(code, 0)) + d * (-best[0] / max(seen, 1)))
                likely[code] = n = max(n, 0)
                if n > 0:
                    heapq.heappush(own, self.key(code, n))
        for entry in aside:
            heapq.heappush(self.heap, entry)
        return out


def learn_merges(words: DataFrame, num_merges: int, candidates: int = PAIRS, contexts: int = SAMPLE,
                 around: int | None = None) -> list[tuple[str, str, int]]:
    """Byte-pair merges ``(a, b, count when made)`` of ``words(word, n)`` in the exact greedy order (ties →
    lexicographically smallest), until ``num_merges`` different symbols were made or no pair is left.

    The driver holds the counts of the ``candidates`` best pairs and, to guess by, the ``contexts`` most frequent
    words. ``around`` is without effect."""
    spark = words.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    letters = alphabet_of(words)
    names = ["", *letters]
    numbers = {s: i for i, s in enumerate(names)}
    alphabet, there = len(letters), set(letters)
    spread = max(spark.sparkContext.defaultParallelism, words.count() // ROW_WORDS)
    state = _store(words.repartition(spread, "word"), numbers)
    often = words.orderBy(F.col("n").desc(), "word").limit(contexts).collect() if letters else []
    sample = Stretch(*_packed([r["word"] for r in often], [r["n"] for r in often], numbers)) if often else None

    def number(a: int, b: int) -> int:
        s = names[a] + names[b]
        if s not in numbers:
            numbers[s] = len(names)
            names.append(s)
        return numbers[s]

    made: list[tuple[str, str, int]] = []
    done: list[tuple[int, int, int]] = []  # merges not yet in the stored words
    counts, tries = None, FIRST_GUESSES
    while letters and len(there) - alphabet < num_merges:
        best = counts.best() if counts else None
        if counts is None or (best is None or not counts.proven(best)) and counts.beyond is not None or len(done) > REPLAYED:
            state, done = (_replayed(state, done) if done else state), []
            sample = Stretch(*sample.left())
            if counts is None or best is None or not counts.proven(best):
                counts = _Counts(_ranked(state, names, candidates + 1), candidates, names, {numbers[t] for t in there})
            best = counts.best()
        if best is None:
            break
        tried = counts.guess(sample, number, min(tries, num_merges - (len(there) - alphabet)))
        right = 0
        for step, deltas in zip(tried, _changes(state, done, tried)):
            best = counts.best()
            if best is None or best[3] != (step[0] << SHIFT) | step[1] or not counts.proven(best):
                break
            made.append((best[1], best[2], -best[0]))
            there.add(names[step[2]])
            counts.change(deltas)
            sample.merge(*step)
            done.append(step)
            right += 1
            if len(there) - alphabet >= num_merges:
                break
        tries = min(max(2 * right, 8), GUESSES)
    return made


def vocabulary(words: DataFrame, merges: list[tuple[str, str, int]], character_coverage: float = 1.0) -> list[str]:
    """Ids: 0 pad, 1 unknown, then base symbols in code-point order, then merged tokens in rank order.

    ``character_coverage < 1`` keeps only the most frequent characters whose cumulative share of
    all character occurrences stays within the coverage (the rest encode as unknown). The
    character table is bounded by the alphabet size, so its window and collect are small.
    """
    chars = (words.select("n", F.explode(symbols(F.col("word"))).alias("s"))
             .groupBy("s").agg(F.sum("n").alias("c")))
    w = Window.orderBy(F.col("c").desc(), "s").rowsBetween(Window.unboundedPreceding, -1)
    chars = chars.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))) \
        .withColumn("total", F.sum("c").over(Window.partitionBy()))
    kept = chars.where((F.col("before") < F.col("total") * F.lit(character_coverage)) | (F.col("s") == BOUNDARY))
    base_syms = sorted(r["s"] for r in kept.select("s").collect())
    return list(dict.fromkeys(["<pad>", "<unk>"] + base_syms + [a + b for a, b, _ in merges]))


SMALL_WORDS = 1_000_000  # distinct words up to this many are broadcast, more are joined by salted shuffle
HOT_WORD, SALTS = 100_000, 64  # occurrences from which a word is dealt over sub-keys


def segment(words: DataFrame, merges: list[tuple[str, str, int]], vocab: list[str]) -> DataFrame:
    """``word, ids array<int>`` of ``words(word)``: merges by rank, unknown symbols as 1. The merge table is bounded
    by the vocabulary size and ships with the closure."""
    ship_package(words.sparkSession)
    ranks: dict[tuple[str, str], int] = {}
    for i, (a, b, _) in enumerate(merges):
        ranks.setdefault((a, b), i)
    ids = {t: i for i, t in enumerate(vocab)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [
                [ids.get(s, UNK_ID) for s in merge_word([BOUNDARY, *w], ranks)] for w in batch["word"]]})

    return words.select("word").mapInPandas(run, "word string, ids array<int>")


def encode(df: DataFrame, text_col: str, keep: list[str], merges: list[tuple[str, str, int]],
           vocab: list[str], maxlen: int | None = None) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of the whole text (unknown → 1); with ``maxlen`` padded (0) or cut to
    that length.

    Each distinct word is segmented once; its ids join back to the words' places in the texts, by broadcast if
    the counted words are few, otherwise by shuffle with frequent words dealt over sub-keys. Rows are told
    apart by a number of their own, so repeated or null keys are no matter; null texts give no ids."""
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    parts = F.filter(F.split(F.coalesce("_text", F.lit("")), f"{SPACE}+"), lambda w: w != "")
    placed = rows.select("_row", F.posexplode(parts).alias("_at", "word"))
    counted = written(placed.groupBy("word").agg(F.count(F.lit(1)).alias("m")), "words")
    table = written(segment(counted, merges, vocab), "segmented")
    if counted.count() <= SMALL_WORDS:
        joined = placed.join(F.broadcast(table), "word")
    else:
        hot = counted.where(F.col("m") > HOT_WORD).select("word")
        joined = salted_join(placed, table, ["word"], hot, SALTS, F.xxhash64("_row", "_at"))
    whole = joined.groupBy("_row").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "ids"))), lambda x: x["ids"])).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    if maxlen:
        ids = F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), maxlen)), 1, maxlen)
    return rows.drop("_text").join(whole, "_row", "left").select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], ids.alias("ids"))
