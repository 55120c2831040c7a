"""Registered keys: subword statistics and encoding, padding, text-line sink, weighted classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pad_sequence
from corpuslens.functions.text import normalize_classical
from corpuslens.operators import scoring as SC
from corpuslens.operators import splits as SP
from corpuslens.operators import subword as SW
from corpuslens.operators import train as TR
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import documents, labeled_fx
from corpuslens.plans.labels import SPLIT_SQL
from corpuslens.session import reliable_checkpoint
from corpuslens.sources import sinks as W

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _train_texts(spark, sf):
    """Normalised texts of the train split only (vocabulary statistics must not see val/test)."""
    s = SP.split_groups(labeled_fx(spark, sf), "doc_id", "text", 0.10, 0.10, 42).where(F.col("split") == "train")
    return s.select("doc_id", normalize_classical(F.col("text")).alias("text"))


TRAIN_TEXT_SQL = SPLIT_SQL.rstrip() + f"""
, trn AS (SELECT f.doc_id, {S.norm_classical('f.text')} AS text FROM labeled_fx f JOIN asg a USING (doc_id)
          WHERE a.split = 'train'),
wf AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM trn) x
       WHERE length(word) > 0 GROUP BY word)
"""


@register("word_frequencies", TRAIN_TEXT_SQL + "SELECT word, n FROM wf")
def word_frequencies(spark, sf):
    return SW.word_frequencies(_train_texts(spark, sf))


@register("symbol_pair_counts", TRAIN_TEXT_SQL + """
, sy AS (SELECT word, n, list_transform(range(1, length('▁' || word) + 1), lambda i: substring('▁' || word, i, 1)) AS s FROM wf),
pr AS (SELECT n, unnest(list_transform(range(1, len(s)), lambda i: [s[i], s[i + 1]])) AS p FROM sy)
SELECT p[1] AS a, p[2] AS b, sum(n)::BIGINT AS n FROM pr GROUP BY ALL""")
def symbol_pair_counts(spark, sf):
    wf = SW.word_frequencies(_train_texts(spark, sf))
    return SW.pair_counts(wf.select("word", "n", SW.symbols(F.col("word")).alias("sym")))


VOCAB_SIZE = 8_000  # all symbols: pad, unknown, characters and merged tokens


def _merges(wf):
    return SW.learn_merges(wf, VOCAB_SIZE - len(SW.vocabulary(wf, [])))


def _merge_rows(spark, merges):
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(merges)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rank", "a", "b", "n"]), "rank int, a string, b string, n long")


@register("bpe_merges")
def bpe_merges(spark, sf):
    return _merge_rows(spark, _merges(reliable_checkpoint(SW.word_frequencies(_train_texts(spark, sf)))))


FIRST = 25  # merges, few enough for SQL to make one after the other
FIRST_MERGES_SQL = TRAIN_TEXT_SQL + f"""
, st AS (SELECT n, list_aggregate(list_transform(string_split('▁' || word, ''), lambda c: chr(1) || c || chr(2)), 'string_agg', '') AS s FROM wf),
bpe(step, a, b, c, n, s) AS (
  SELECT 0, '', '', 0::BIGINT, n::BIGINT, s FROM st
  UNION ALL
  SELECT step + 1, best.a, best.b, best.c, x.n, replace(x.s, chr(1) || best.a || chr(2) || chr(1) || best.b || chr(2),
                                                        chr(1) || best.a || best.b || chr(2))
  FROM bpe x, (SELECT p[1] AS a, p[2] AS b, sum(n)::BIGINT AS c FROM (
                 SELECT n, unnest(list_transform(range(1, len(y)), lambda i: [y[i], y[i + 1]])) AS p
                 FROM (SELECT n, string_split(substring(s, 2, length(s) - 2), chr(2) || chr(1)) AS y FROM bpe))
               GROUP BY ALL ORDER BY c DESC, a, b LIMIT 1) best
  WHERE step < {FIRST}),
mg AS (SELECT DISTINCT step - 1 AS rank, a, b, c AS n FROM bpe WHERE step > 0)"""


@register("bpe_first_merges", FIRST_MERGES_SQL + " SELECT rank, a, b, n FROM mg")
def bpe_first_merges(spark, sf):
    return _merge_rows(spark, SW.learn_merges(reliable_checkpoint(SW.word_frequencies(_train_texts(spark, sf))), FIRST))


@register("subword_encode_first", FIRST_MERGES_SQL + f"""
, base AS (SELECT DISTINCT unnest(string_split('▁' || word, '')) AS t FROM wf),
vocab AS (SELECT t, row_number() OVER (ORDER BY t) + 1 AS id FROM base
          UNION ALL SELECT a || b, (SELECT count(*) FROM base) + 2 + rank FROM mg),
steps AS (SELECT list(chr(1) || a || chr(2) || chr(1) || b || chr(2) ORDER BY rank) AS l FROM mg),
tx AS (SELECT doc_id, {S.norm_classical('text')} AS text FROM labeled_fx),
ow AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM tx) WHERE length(word) > 0),
sg AS (SELECT word, list_reduce(list_prepend(list_aggregate(list_transform(string_split('▁' || word, ''), lambda c: chr(1) || c || chr(2)),
                                                            'string_agg', ''), l),
                                lambda acc, p: replace(acc, p, replace(p, chr(2) || chr(1), ''))) AS s FROM ow, steps),
sy AS (SELECT word, unnest(y) AS t, unnest(range(1, len(y) + 1)) AS i
       FROM (SELECT word, string_split(substring(s, 2, length(s) - 2), chr(2) || chr(1)) AS y FROM sg)),
wi AS (SELECT word, list(coalesce(id, 1) ORDER BY i) AS ids FROM sy LEFT JOIN vocab USING (t) GROUP BY word),
pl AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM (SELECT doc_id, string_split(text, ' ') AS w FROM tx)),
dn AS (SELECT doc_id, array_to_string(flatten(list(ids ORDER BY spot)), ',') AS ids FROM pl JOIN wi USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS ids FROM tx LEFT JOIN dn USING (doc_id)""")
def subword_encode_first(spark, sf):
    wf = reliable_checkpoint(SW.word_frequencies(_train_texts(spark, sf)))
    merges = SW.learn_merges(wf, FIRST)
    enc = SW.encode(labeled_fx(spark, sf).select("doc_id", normalize_classical(F.col("text")).alias("text")),
                    "text", ["doc_id"], merges, SW.vocabulary(wf, merges))
    return enc.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


MAXLEN = 50


@register("subword_encode")
def subword_encode(spark, sf):
    wf = reliable_checkpoint(SW.word_frequencies(_train_texts(spark, sf)))
    merges = _merges(wf)
    vocab = SW.vocabulary(wf, merges)
    enc = SW.encode(labeled_fx(spark, sf).select("doc_id", normalize_classical(F.col("text")).alias("text")),
                    "text", ["doc_id"], merges, vocab)
    return enc.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register("pad_sequences", f"""
WITH w AS (SELECT doc_id, list_filter(string_split({S.norm_classical('text')}, ' '), lambda x: length(x) > 0) AS w FROM documents),
ids AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS ids FROM w)
SELECT doc_id, array_to_string((ids || list_transform(range(0, {MAXLEN}), lambda i: 0))[1:{MAXLEN}], ',') AS padded FROM ids""")
def pad_sequences(spark, sf):
    d = documents(spark, sf).select("doc_id", normalize_classical(F.col("text")).alias("t"))
    d = d.select("doc_id", F.filter(F.split("t", " "), lambda x: F.length(x) > 0).alias("w"))
    ids = d.select("doc_id", F.transform("w", lambda x: F.length(x)).alias("ids"))
    return ids.select("doc_id", F.array_join(pad_sequence(F.col("ids"), MAXLEN).cast("array<string>"), ",").alias("padded"))


@register("sink_text_lines", """
WITH s AS (SELECT regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g') AS t
           FROM documents)
SELECT unnest(string_split(t, chr(10))) AS value FROM s WHERE t IS NOT NULL AND length(t) > 0""")
def sink_text_lines(spark, sf):
    path = W.scratch_path(spark, "lines")
    W.write_text_lines(documents(spark, sf), path)
    return spark.read.text(path)


@register("train_eval_weighted")
def train_eval_weighted(spark, sf):
    s = SP.split_groups(labeled_fx(spark, sf), "doc_id", "text", 0.10, 0.10, 42)
    s = s.withColumn("input", SC.build_model_input(F.col("source"), F.col("text")))
    return TR.train_eval(s, "input", "label", 0.3)
