"""Ranked lexical search by the Best Position Algorithm over document shards.

Every item of a query table is ranked against all documents. A document's score is the sum of the integer
impacts of the item's terms in it.

1. One pass over the texts counts each document's terms and keeps its counts of query terms. N, L and the
   document frequencies are Spark aggregates over all documents.
2. Documents are dealt by hash into shards of about ``SHARD`` postings, so a term that most documents hold
   is split over all tasks and a task's memory does not grow with the corpus. A shard builds an impact list
   per term, highest first, and the documents' own postings for direct access.
3. For each item, positions are read from the top of its lists. Each document met is scored in full by
   direct access, which marks its place in all lists as seen. A list's best position is the end of its
   unbroken run of seen places; that may lie far below the last place read. The sum of the impacts at the
   best positions bounds every unseen document. Reading stops when it is strictly below the k-th score, so
   that no tie is lost, or is nothing.
4. A shard gives its k best documents of an item, so the k best of these over all shards are exact.

Items are dealt into blocks of about ``PAIRS`` item-term pairs; the query terms of one block are what is
broadcast, whatever the corpus. An item's terms are those of all rows with its id, once each.

Terms are runs of ASCII letters, digits and any other non-ASCII characters with A-Z lower-cased. Null and
wordless texts count nowhere and match nothing. Every row is a document: rows that share a doc_id are
ranked each by itself, equal scores by ascending doc_id with nulls last. Items without a match, or an
empty table on either side, give no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import as_bytes, by_bytes, in_python, stored
from corpuslens.session import ship_package

SHARD, PAIRS, TOP = 1 << 20, 200_000, 10
STEP, LARGEST_STEP = 16, 1024  # places read from each list in the first round, and in later ones at most
_TERM = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def terms(text: object) -> list[bytes]:
    return as_bytes(text).translate(_TERM).split()


def item_terms(items: DataFrame, item_col: str, text: str) -> DataFrame:
    """``item, term``, each pair once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, t in zip(frame["item"], frame["text"]):
                found = sorted(set(terms(t)))
                name = item if isinstance(item, str) else None  # pandas reads a null as a float
                yield pd.DataFrame({"item": pd.Series([name] * len(found), dtype=object), "term": pd.Series(found, dtype=object)})

    source = items.select(F.col(item_col).cast("string").alias("item"), F.col(text).alias("text"))
    return in_python(source, run, "item string, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, tfs`` of ``docs(id, text)``: the number of terms, and the counts of those in the vocabulary.
    Documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value.get
        for frame in frames:
            for piece in by_bytes(iter([frame]), "text"):
                words = [terms(t) for t in piece["text"]]
                counts = [Counter(map(number, w)) for w in words]
                for c in counts:
                    c.pop(None, None)
                out = pd.DataFrame({"id": piece["id"], "n": [len(w) for w in words], "terms": [list(c) for c in counts],
                                    "tfs": [list(c.values()) for c in counts]})
                yield out[out["n"] > 0]

    named = docs.select(F.col("id").cast("string").alias("id"), "text")  # pandas would make nullable numbers floats
    counted = in_python(named, run, "id string, n long, terms array<int>, tfs array<long>")
    return counted.withColumn("id", F.col("id").cast("long"))


class Shard:
    """Impact lists and direct access of a bounded number of postings."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray):
        """Parallel arrays of postings (document number, term, impact above 0) and the documents' ids."""
        self.ids = ids
        by_term = np.lexsort((doc, -impact, term))
        self.names, first = np.unique(term[by_term], return_index=True)
        self.first = np.append(first, len(term))
        self.list_doc, self.list_impact = doc[by_term], impact[by_term]
        by_doc = np.argsort(doc, kind="stable")
        self.term, self.impact = term[by_doc], impact[by_doc]
        self.at = np.searchsorted(doc[by_doc], np.arange(len(ids) + 1))

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        spots = np.flatnonzero(np.isin(self.names, wanted))
        return [(self.list_doc[self.first[i]:self.first[i + 1]], self.list_impact[self.first[i]:self.first[i + 1]])
                for i in spots]

    def scores(self, docs: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Direct access: full scores of the documents over the terms marked in ``chosen``."""
        size = self.at[docs + 1] - self.at[docs]
        start = np.cumsum(size) - size
        rows = np.repeat(self.at[docs] - start, size) + np.arange(size.sum())
        return np.add.reduceat(np.where(chosen[self.term[rows]], self.impact[rows], 0), start)

    def best(self, wanted: np.ndarray, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best for the terms ``wanted``, and how many documents were scored."""
        chosen = np.zeros(n_terms, dtype=bool)
        chosen[wanted] = True
        lists = self.lists(wanted)
        place = [0] * len(lists)  # how many places from the top of each list have been seen without a break
        seen = np.zeros(len(self.ids), dtype=bool)
        docs, score = np.empty(0, np.int64), np.empty(0, np.int64)
        step, scored = STEP, 0
        while True:
            new = np.unique(np.concatenate([lst[p:p + step] for p, (lst, _) in zip(place, lists)])) if lists else docs
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                scored += len(new)
                docs, score = np.append(docs, new), np.append(score, self.scores(new, chosen))
                order = np.lexsort((self.ids[docs], -score))[:k]
                docs, score = docs[order], score[order]
            bound = 0
            for i, (lst, impact) in enumerate(lists):
                place[i] = _unbroken(seen, lst, place[i])
                if place[i] < len(lst):
                    bound += int(impact[place[i] - 1])
            if bound <= 0 or len(docs) == k and bound < score[-1]:
                return docs, score, scored
            step = min(2 * step, LARGEST_STEP)


def _unbroken(seen: np.ndarray, order: np.ndarray, place: int) -> int:
    """The number of places from the top whose documents have all been seen; ``place`` of them are known."""
    size = 256
    while place < len(order):
        gap = np.flatnonzero(~seen[order[place:place + size]])
        if len(gap):
            return place + int(gap[0])
        place += size
        size *= 4
    return len(order)


def _search(found: DataFrame, items: dict[str | None, np.ndarray], weight: np.ndarray, n_docs: int, total: int,
            shard: int, k: int) -> DataFrame:
    """``item, id, score``: each shard's k best documents of each item."""
    size = found.agg(F.sum(F.size("terms")).alias("p")).first().p or 0
    shared = found.sparkSession.sparkContext.broadcast((items, weight))
    schema = pa.schema([("item", pa.string()), ("id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        wanted, w = shared.value
        rows, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        n = table["n"].to_pylist()
        m = np.array([10 + 90 * x * n_docs // total for x in n], dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(rows.offsets.to_numpy()))
        term, tf = rows.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        ids = table["id"].combine_chunks()
        own = Shard(doc[some], term[some], impact[some],
                    ids.fill_null(np.iinfo(np.int64).max).to_numpy())  # nulls last among equal scores
        out = []
        for item, chosen in wanted.items():
            best, score, _ = own.best(chosen, len(w), k)
            out.append(pa.table([pa.array([item] * len(best), pa.string()), ids.take(pa.array(best)), pa.array(score)],
                                schema=schema))
        return pa.concat_tables(out)

    dealt = (found.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("id", "n", "terms"), F.lit(-(-size // shard) or 1))))
    return dealt.groupBy("shard").applyInArrow(run, "item string, id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = TOP, shard: int = SHARD, pairs: int = PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item with a score above 0."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    wanted = stored(item_terms(items, item_col, item_text), "item-terms")
    blocks = -(-wanted.count() // pairs)
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))
    found = None
    for block in range(blocks):
        rows = wanted.where(F.col("block") == block).select("item", "term").collect()  # the block's query terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        by_item: dict[str | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r.item, []).append(vocabulary[bytes(r.term)])
        counted = stored(postings(source, vocabulary), "postings")
        size = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not size.n or not rows:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * size.n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        part = _search(counted, {i: np.array(t) for i, t in by_item.items()}, weight, size.n, size.l, shard, k)
        found = part if found is None else found.unionByName(part)
    kind = items.schema[item_col].dataType
    if found is None:
        return docs.sparkSession.createDataFrame([], "item string, rank int, doc_id long, score long").select(
            F.col("item").cast(kind).alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").cast(kind).alias(item_col), "rank", F.col("id").alias(id_col), "score")
