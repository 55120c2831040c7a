"""Registered keys: keyword catalogue and matching, lexicon scores, nested page ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import strip
from corpuslens.operators import attribution as AT
from corpuslens.operators import keywords as K
from corpuslens.operators import matcher as M
from corpuslens.operators import scoring as SC
from corpuslens.plans import fixtures as FX
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import catalog_fx, documents, pages_fx
from corpuslens.sources import readers as R
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


def _sql_list(terms):
    return "[" + ", ".join(S.q(K.norm_term(t)) for t in terms) + "]"


# token and n-gram CTEs in SQL (the oracle's own statement of whole-token matching)
def _grams_cte(source: str, id_col: str, text_col: str, extra: str = "", longest: int = 3) -> str:
    runs = ",".join(f"""
          list_transform(range(1, len(t) - {n - 2}), lambda i: {" || ' ' || ".join(f"t[i + {k}]" for k in range(n))})""" for n in range(2, longest + 1))
    return f"""
tk AS (SELECT {id_col} AS id{extra}, list_filter(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}_]+'),
                                          lambda x: length(x) > 0) AS t FROM {source}),
gr AS (SELECT id{extra}, list_concat(t,{runs}) AS g FROM tk)"""


LEXICON = FX.FIXTURE_NEGATIVE_LEXICON
EXCL = K.exclusion_phrases()


@register("keyword_match", S.with_(_grams_cte("documents", "doc_id", "text", ", lang, source")) + f"""
SELECT id AS doc_id, source FROM gr
WHERE list_has_any(g, {_sql_list(LEXICON)}) AND lang = 'en' AND NOT list_has_any(g, {_sql_list(EXCL)})""")
def keyword_match(spark, sf):
    d = documents(spark, sf)
    g = K.with_ngrams(d, "text", ["doc_id", "lang", "source"])
    cond = K.keyword_predicate(F.col("grams"), F.col("lang"), [LEXICON], EXCL, "en")
    return g.where(cond).select("doc_id", "source")


def _catalog_values() -> str:
    rows = [(k, c, tn) for k, c, _, _, tn in K.catalog_rows()] + [("topic", "lexicon_negative", K.norm_term(t))
                                                                   for t in LEXICON]
    vals = ", ".join(f"({S.q(k)}, {S.q(c)}, {S.q(t)})" for k, c, t in rows)
    return f"(VALUES {vals}) AS kw(kind, code, term)"


@register("keyword_tag_join", S.with_(_grams_cte("documents", "doc_id", "text")) + f"""
, ex AS (SELECT id, unnest(g) AS gram FROM gr)
SELECT ex.id AS doc_id, kw.kind, kw.code, count(*) AS n_hits FROM ex JOIN {_catalog_values()} ON kw.term = ex.gram
GROUP BY ALL""")
def keyword_tag_join(spark, sf):
    cat = K.catalog_df(spark, [("topic", "lexicon_negative", 99, t) for t in LEXICON])
    return K.tag_join(documents(spark, sf), "doc_id", "text", cat)


@register("lexicon_score", S.with_(_grams_cte("documents", "doc_id", "text")) + f"""
, c AS (SELECT id, len(list_filter(t, lambda w: list_contains({_sql_list([t for t in FX.POSITIVE_TERMS if ' ' not in t])}, w))) AS p,
               len(list_filter(t, lambda w: list_contains({_sql_list([t for t in FX.NEGATIVE_TERMS if ' ' not in t])}, w))) AS n
        FROM tk)
SELECT id AS doc_id, p, n, round((p + 1) / (p + n + 2), 6) AS score FROM c""")
def lexicon_score(spark, sf):
    d = documents(spark, sf).select("doc_id", K.tokens(F.col("text")).alias("tok"))
    p, n, s = SC.lexicon_score(F.col("tok"), [t for t in FX.POSITIVE_TERMS if " " not in t],
                               [t for t in FX.NEGATIVE_TERMS if " " not in t])
    return d.select("doc_id", p.alias("p"), n.alias("n"), F.round(s, 6).alias("score"))


def _combo_sql() -> str:
    rows = []
    for ui, (code, upat) in enumerate(K.INSTITUTIONS):
        for gi, (name, gpat) in enumerate(K.TOPIC_GROUPS):
            q = f"({upat}) ({gpat}) {K.BASE_FILTERS} since:2021-01-01 until:2022-01-01"
            rows.append(f"({ui * len(K.TOPIC_GROUPS) + gi}, {S.q(code)}, {S.q(name)}, {len(q)}, "
                        f"{_sql_list(K.or_terms(upat))}, {_sql_list(K.or_terms(gpat))})")
    return "(VALUES " + ", ".join(rows) + ") AS cb(combo_rank, university, grp, query_chars, uterms, gterms)"


def _picked(terms, at: str, there: str) -> str:
    return f"CASE WHEN {there} THEN ' | ' || ([{', '.join(map(S.q, terms))}])[({at}) % {len(terms)} + 1] ELSE '' END"


CATALOG_FX = f"""
catalog_fx AS (SELECT doc_id, (CASE WHEN doc_id % 10 = 7 THEN '' ELSE coalesce(text, '') END)
        || {_picked(FX.ALIASES, 'doc_id', 'doc_id % 4 <> 3')} || {_picked(FX.TOPIC_TERMS, 'doc_id // 2', 'doc_id % 5 <> 4')}
        || {_picked(FX.ALIASES, 'doc_id * 7 + 3', 'doc_id % 6 = 0')} || {_picked(FX.EXCLUDED, 'doc_id // 11', 'doc_id % 11 = 0')} AS text,
      CASE WHEN doc_id % 3 <> 1 THEN '{K.BASE_LANG}' ELSE lang END AS lang, (doc_id * 13 % 7) % 3 AS batch FROM documents),
-- a dotted capital I becomes an i and a combining dot, as it does in Unicode's full lower-casing
folded AS (SELECT doc_id, text AS whole, replace(text, 'İ', 'i' || chr(775)) AS text, lang, batch FROM catalog_fx),"""
COMBO_HITS = f"""
hit AS (SELECT id, whole, batch, lang, cb.* FROM {_combo_sql()} JOIN gr
        ON list_has_any(gr.g, cb.uterms) AND list_has_any(gr.g, cb.gterms) AND lang = '{K.BASE_LANG}'
           AND NOT list_has_any(gr.g, {_sql_list(EXCL)}))"""
COMBO_CTES = "WITH " + CATALOG_FX + _grams_cte("folded", "doc_id", "text", ", whole, lang, batch", 4).lstrip() + "," + COMBO_HITS
COMBO_PHRASES = M.compile_phrases((f"{kind}:{code}", term) for kind, code, _, term, _ in K.catalog_rows())


def _combo_hits(rows):
    """The rows in the base filter's language with ``matched``, the ranks of the combos that find them."""
    rows = rows.where(F.col("lang") == K.BASE_LANG)
    return M.match_queries(rows, "text", COMBO_PHRASES, K.combo_queries())


@register("combo_match", COMBO_CTES + "SELECT id AS doc_id, combo_rank FROM hit")
def combo_match(spark, sf):
    """(any alias) AND (any topic term) AND language AND NOT (any excluded phrase), for all 70 combos at once."""
    return _combo_hits(catalog_fx(spark, sf)).select("doc_id", F.explode("matched").alias("combo_rank"))


@register("combo_catalog", COMBO_CTES + f"""
SELECT cb.combo_rank, cb.university, cb.grp AS "group", cb.university || '_' || cb.grp AS combo, cb.query_chars,
       cb.query_chars > {K.MAX_QUERY_CHARS} AS skipped, count(hit.id) AS n_docs
FROM {_combo_sql()} LEFT JOIN hit USING (combo_rank) GROUP BY ALL""")
def combo_catalog(spark, sf):
    """70 combos with the composed query and length guard, plus how many documents each finds.

    Documents are matched once; what is shuffled is one partial count per combo and task.
    """
    counts = combo_match(spark, sf).groupBy("combo_rank").agg(F.count(F.lit(1)).alias("n_docs"))
    out = K.combo_catalog(spark).join(F.broadcast(counts), "combo_rank", "left").fillna(0, ["n_docs"])  # at most 70 rows
    return out.select("combo_rank", "university", "group", "combo", "query_chars", "skipped", "n_docs")


@register("tag_posts", COMBO_CTES + """
, first AS (SELECT whole, min((batch, combo_rank, id)) AS o FROM hit GROUP BY whole),
won AS (SELECT o[1] AS batch, o[2] AS combo_rank, o[3] AS doc_id FROM first)
SELECT DISTINCT doc_id, won.batch, combo_rank, university, grp AS "group", '' AS tags FROM won JOIN hit USING (combo_rank)""")
def tag_posts(spark, sf):
    """Posts tagged with the combo they came from, and a blank column for labels set by hand.

    The posts land in three batches. A text belongs to the earliest batch that has it, and in it to the combo of the
    lowest rank; what a batch has decided stays when the next one is appended."""
    posts = _combo_hits(catalog_fx(spark, sf)).select(
        "text", "batch", F.array_min("matched").alias("rank"), F.col("doc_id").alias("seq"))
    table = AT.AttributionTable(spark, W.scratch_path(spark, "attribution"))
    for batch in range(3):
        table.append(posts.where(F.col("batch") == batch), batch)
    combos = F.broadcast(K.combo_catalog(spark).select("combo_rank", "university", "group"))  # 70 rows
    tagged = table.read().select(F.col("seq").alias("doc_id"), "batch", F.col("rank").alias("combo_rank"))
    return tagged.join(combos, "combo_rank").select("doc_id", "batch", "combo_rank", "university", "group",
                                                    F.lit("").alias("tags"))


@register("top_sources", """
SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5""")
def top_sources(spark, sf):
    d = documents(spark, sf)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(5)


PAGES_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT 'tweet' AS "type", CAST(conv_id * 1000 + turn AS VARCHAR) AS id,
       'https://x.example/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url, text,
       '2024-01-15T12:00:00Z' AS createdAt,
       CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 3 = 2 THEN NULL
            ELSE ' loc' || CAST(conv_id % 7 AS VARCHAR) || ' ' END AS location,
       CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS userName
FROM c"""


def _landed_pages(spark, sf):
    path = W.scratch_path(spark, "pages_json")
    pages_fx(spark, sf).drop("conv_id", "page_no").write.mode("overwrite").json(path)
    return R.read_json_pages(spark, path)


@register("ingest_json_pages", PAGES_SQL)
def ingest_json_pages(spark, sf):
    p = _landed_pages(spark, sf)
    return p.select("type", "id", "url", "text", "createdAt", F.col("author.location").alias("location"),
                    F.col("author.userName").alias("userName"))


@register("flatten_nested_defaults", f"""
SELECT 'tweet' AS "type", CAST(conv_id * 1000 + turn AS VARCHAR) AS id,
       trim('https://x.example/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)) AS url,
       {S.strip("text")} AS text, '2024-01-15T12:00:00Z' AS createdAt,
       CASE WHEN turn % 5 = 4 OR turn % 3 = 2 THEN '' ELSE 'loc' || CAST(conv_id % 7 AS VARCHAR) END AS location,
       CASE WHEN turn % 5 = 4 THEN '' ELSE {S.strip("role")} END AS authorUserName
FROM conversations WHERE length({S.strip("coalesce(text, '')")}) > 0""")
def flatten_nested_defaults(spark, sf):
    p = _landed_pages(spark, sf)
    d = lambda c: F.coalesce(strip(c), F.lit(""))
    out = p.select("type", d(F.col("id")).alias("id"), d(F.col("url")).alias("url"), strip(F.col("text")).alias("text"),
                   d(F.col("createdAt")).alias("createdAt"), d(F.col("author.location")).alias("location"),
                   d(F.col("author.userName")).alias("authorUserName"))
    return out.where(F.length(F.coalesce("text", F.lit(""))) > 0)
