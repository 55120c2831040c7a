"""Registered keys over the post table: normalisers, dates, filters, caps, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.dates import in_date_range, parse_created_at
from corpuslens.functions.text import normalize, strip
from corpuslens.operators import dedupe as D
from corpuslens.operators import keywords as K
from corpuslens.operators import scoring as SC
from corpuslens.plans import fixtures as FX
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import documents, labeled_fx, posts_fx
from corpuslens.sources import readers as R
from corpuslens.sources import sinks as W
from corpuslens.sources.schemas import POST_COLUMNS, POST_SCHEMA, conform

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


P = S.with_(S.POSTS_FX)


def _norm_key(profile, sql_expr):
    @register(f"normalize_{profile}", P + f"SELECT id, {sql_expr} AS text_norm FROM posts_fx")
    def fn(spark, sf):
        return posts_fx(spark, sf).select("id", normalize(F.col("text"), profile).alias("text_norm"))
    return fn


_norm_key("minhash", S.norm_minhash("text"))
_norm_key("predict", S.norm_predict("text"))
_norm_key("classical", S.norm_classical("text"))
_norm_key("basic", S.norm_basic("text"))

SQL_CREATED = ("coalesce(CASE WHEN regexp_matches(trim(createdAt), " + S.q(
    r"^[A-Za-z]{3} [A-Za-z]{3} [0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4} [0-9]{4}$")
    + ") THEN try_strptime(substr(trim(createdAt), 5, 6) || ' ' || right(trim(createdAt), 4), '%b %d %Y')::DATE END,"
    " CASE WHEN regexp_matches(trim(createdAt), " + S.q(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$")
    + ") THEN try_strptime(substr(trim(createdAt), 1, 10), '%Y-%m-%d')::DATE END)")


@register("parse_created_at", P + f"SELECT id, createdAt, {SQL_CREATED} AS created_date FROM posts_fx")
def parse_created(spark, sf):
    p = posts_fx(spark, sf)
    return p.select("id", "createdAt", parse_created_at(F.col("createdAt")).alias("created_date"))


SINCE, UNTIL = "2024-01-02", "2024-01-03"


@register("filter_date_range", P + f"""
SELECT id, created_date FROM (SELECT id, {SQL_CREATED} AS created_date FROM posts_fx) t
WHERE created_date >= DATE '{SINCE}' AND created_date < DATE '{UNTIL}'""")
def filter_date_range(spark, sf):
    p = posts_fx(spark, sf).select("id", parse_created_at(F.col("createdAt")).alias("created_date"))
    return p.where(in_date_range(F.col("created_date"), SINCE, UNTIL))


@register("filter_blank", P + f"""
, holes AS (SELECT id, CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(9) || ' ' || chr(160) || chr(10) ELSE text END AS text,
                   CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE createdAt END AS createdAt FROM posts_fx)
SELECT id FROM holes WHERE length({S.strip("coalesce(text, '')")}) > 0 AND length({S.strip("coalesce(createdAt, '')")}) > 0""")
def filter_blank(spark, sf):
    at = F.col("seq")
    p = posts_fx(spark, sf).select(
        "id", F.when(at % 7 == 1, "").when(at % 7 == 2, "\t \u00a0\n").when(at % 7 != 0, F.col("text")).alias("text"),
        F.when(at % 5 == 1, "  ").when(at % 5 != 0, F.col("createdAt")).alias("createdAt"))
    return p.where((F.length(strip(F.coalesce("text", F.lit("")))) > 0)
                   & (F.length(strip(F.coalesce("createdAt", F.lit("")))) > 0)).select("id")


KINDS = [("RT @x: ", ""), ("@x ", ""), ("", " https://t.example/a"), ("", " WWW.t.example"), ("", " pic.example/x"), ("", " photo.JPG"),
         ("", " photo.jpgs"), ("RT: ", ""), ("a@b ", ""), ("", ""), ("", "")]  # what comes before and behind the text


@register("filter_content_kind", f"""
WITH k AS (SELECT doc_id, ([{", ".join(S.q(a) for a, _ in KINDS)}])[doc_id % {len(KINDS)} + 1] || coalesce(text, '')
                  || ([{", ".join(S.q(b) for _, b in KINDS)}])[doc_id % {len(KINDS)} + 1] AS text FROM documents)
SELECT doc_id FROM k
WHERE NOT (starts_with(coalesce(text, ''), 'RT @') OR starts_with(coalesce(text, ''), '@')
           OR regexp_matches(coalesce(text, ''), {S.q(K.LINK_PATTERN[4:])}, 'i')
           OR regexp_matches(coalesce(text, ''), {S.q(K.MEDIA_PATTERN[4:])}, 'i'))""")
def filter_content_kind(spark, sf):
    at = (F.col("doc_id") % len(KINDS) + 1).cast("int")
    around = [F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), at) for i in (0, 1)]
    d = documents(spark, sf).withColumn("text", F.concat(around[0], F.coalesce("text", F.lit("")), around[1]))
    return d.where(K.content_kind_ok(F.col("text"))).select("doc_id")


CAP = 10


@register("cap_latest_per_combo", P + f"""
SELECT id, university, "group" FROM (
  SELECT id, university, "group",
         row_number() OVER (PARTITION BY university, "group" ORDER BY ts DESC, seq) AS rn
  FROM posts_fx WHERE length({S.strip("text")}) > 0) t WHERE rn <= {CAP}""")
def cap_latest_per_combo(spark, sf):
    p = posts_fx(spark, sf).where(F.length(strip(F.col("text"))) > 0)
    return D.cap_per_group(p, ["university", "group"], [F.col("ts").desc(), F.col("seq")], CAP) \
        .select("id", "university", "group")


TOPK = 50


@register("top_k_latest", P + f"SELECT id, ts FROM posts_fx ORDER BY ts DESC, seq LIMIT {TOPK}")
def top_k_latest(spark, sf):
    p = posts_fx(spark, sf).select("id", "ts", "seq")
    return D.top_k(p, [F.col("ts").desc(), F.col("seq")], TOPK).select("id", "ts")


@register("combo_counts", P + """
SELECT university, "group", count(*) AS n FROM posts_fx GROUP BY GROUPING SETS ((university, "group"), ())""")
def combo_counts(spark, sf):
    p = posts_fx(spark, sf)
    r = p.rollup("university", "group").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return r.where(F.col("_g").isin(0, 3)).select("university", "group", "n")


_NULLS = {c: "NULL::VARCHAR" for c in POST_COLUMNS}
_NULLS.update({"id": "id", "text": "text", "createdAt": "createdAt", "university": "university",
               "group": '"group"'})
CONFORM_SELECT = ", ".join(f'{v} AS "{c}"' for c, v in _NULLS.items())


@register("conform_schema", P + f"SELECT {CONFORM_SELECT} FROM posts_fx")
def conform_schema(spark, sf):
    return conform(posts_fx(spark, sf), POST_SCHEMA)


@register("append_batches", P + """
SELECT id, text, university, "group", 0 AS _batch FROM posts_fx WHERE seq % 2 = 0
UNION ALL SELECT id, text, university, NULL::VARCHAR AS "group", 1 AS _batch FROM posts_fx WHERE seq % 2 = 1""")
def append_batches(spark, sf):
    p = posts_fx(spark, sf)
    old = p.where(F.col("seq") % 2 == 0).select("id", "text", "university", "group")
    new = p.where(F.col("seq") % 2 == 1).select("id", "text", "university")
    return R.append_batches(old, new).select("id", "text", "university", "group", "_batch")


def _write_posts_csv(spark, sf):
    path = W.scratch_path(spark, "posts_csv")
    W.write_csv(conform(posts_fx(spark, sf), POST_SCHEMA), path)
    return path


@register("scan_csv_all_string", P + f"SELECT {CONFORM_SELECT} FROM posts_fx")
def scan_csv_all_string(spark, sf):
    return R.read_csv_all_string(spark, _write_posts_csv(spark, sf), POST_COLUMNS)


@register("sink_csv_roundtrip", P + f"SELECT {CONFORM_SELECT} FROM posts_fx")
def sink_csv_roundtrip(spark, sf):
    path = W.scratch_path(spark, "posts") + ".csv"
    W.write_any(conform(posts_fx(spark, sf), POST_SCHEMA), path)
    return R.read_any(spark, path, POST_SCHEMA)


TYPED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("source", T.StringType()), T.StructField("label", T.IntegerType()),
                      T.StructField("is_synth", T.IntegerType())])


@register("scan_csv_typed", S.with_(S.LABELED_FX) + "SELECT doc_id, text, source, label, is_synth FROM labeled_fx")
def scan_csv_typed(spark, sf):
    path = W.scratch_path(spark, "labeled_csv")
    W.write_csv(labeled_fx(spark, sf), path)
    return R.read_csv_typed(spark, path, TYPED)


@register("scan_by_extension", S.with_(S.LABELED_FX) + """
SELECT doc_id, label, is_synth, fmt FROM labeled_fx, (VALUES ('csv'), ('json'), ('parquet'), ('orc')) f(fmt)""")
def scan_by_extension(spark, sf):
    df = labeled_fx(spark, sf).select("doc_id", "label", "is_synth")
    base = W.scratch_path(spark, "by_ext")
    out = None
    for ext in ("CSV", "json", "Parquet", "orc"):
        path = f"{base}/data.{ext}"
        W.write_any(df, path)
        part = R.read_any(spark, path, df.schema, multi_line=False).select("doc_id", "label", "is_synth",
                                                         F.lit(ext.lower()).alias("fmt"))
        out = part if out is None else out.unionByName(part)
    return out


@register("build_model_input", P + f"""
SELECT id, 'Üniversite: ' || coalesce(university, 'nan') || ' || ' || {S.norm_predict("coalesce(text, 'nan')")} AS input
FROM posts_fx""")
def build_model_input(spark, sf):
    p = posts_fx(spark, sf)
    return p.select("id", SC.build_model_input(F.col("university"), F.col("text")).alias("input"))


@register("model_columns", S.with_(S.LABELED_FX) + f"""
SELECT doc_id, 'Üniversite: ' || coalesce(source, 'nan') || ' || ' || {S.norm_predict("coalesce(text, 'nan')")} AS input, label AS labels
FROM labeled_fx""")
def model_columns(spark, sf):
    """The two columns a trainer reads: ``input`` and ``labels``."""
    return labeled_fx(spark, sf).select("doc_id", SC.build_model_input(F.col("source"), F.col("text")).alias("input"),
                                        F.col("label").alias("labels"))


def _lexicon_sql_logits(inp: str) -> str:
    neg = "[" + ", ".join(S.q(t.lower()) for t in FX.NEGATIVE_TERMS if " " not in t) + "]"
    pos = "[" + ", ".join(S.q(t.lower()) for t in FX.POSITIVE_TERMS if " " not in t) + "]"
    tok = f"list_filter(regexp_split_to_array(lower({inp}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 0)"
    return (f"len(list_filter({tok}, lambda w: list_contains({neg}, w)))::DOUBLE AS z0, "
            f"len(list_filter({tok}, lambda w: list_contains({pos}, w)))::DOUBLE AS z1, "
            f"{SC.IRRELEVANT_LOGIT} AS z2")


BATCH_LABEL_SQL = P + f"""
, inp AS (SELECT id, text, createdAt, university, "group",
                 'Üniversite: ' || coalesce(university, 'nan') || ' || ' || {S.norm_predict("coalesce(text, 'nan')")} AS input
          FROM posts_fx),
z AS (SELECT *, {_lexicon_sql_logits('input')} FROM inp),
pr AS (SELECT *, greatest(z0, z1, z2) AS zm FROM z),
sm AS (SELECT *, exp(z0 - zm) / (exp(z0 - zm) + exp(z1 - zm) + exp(z2 - zm)) AS p0,
                 exp(z1 - zm) / (exp(z0 - zm) + exp(z1 - zm) + exp(z2 - zm)) AS p1,
                 exp(z2 - zm) / (exp(z0 - zm) + exp(z1 - zm) + exp(z2 - zm)) AS p2 FROM pr),
am AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 9 END AS pred,
              greatest(p0, p1, p2) AS pmax FROM sm)
SELECT NULL::VARCHAR AS "type", id, NULL::VARCHAR AS url,
       CASE WHEN pred IN (0, 1) AND pmax < {SC.DEFAULT_ABSTAIN} THEN 9 ELSE pred END AS tags,
       text, createdAt, NULL::VARCHAR AS location, NULL::VARCHAR AS authorUserName, university, "group"
FROM am"""


@register("batch_label", BATCH_LABEL_SQL)
def batch_label(spark, sf):
    p = posts_fx(spark, sf)
    inp = p.withColumn("input", SC.build_model_input(F.col("university"), F.col("text")))
    keep = ["id", "text", "createdAt", "university", "group"]
    scored = SC.score_logits(inp, "input", keep, SC.lexicon_model(FX.POSITIVE_TERMS, FX.NEGATIVE_TERMS))
    lab = SC.label_from_logits(scored)
    out_schema = T.StructType([f if f.name != "tags" else T.StructField("tags", T.IntegerType())
                               for f in POST_SCHEMA.fields])
    return conform(lab, out_schema)
