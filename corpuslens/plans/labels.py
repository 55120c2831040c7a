"""Registered keys over labelled rows: contracts, shares, weights, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_basic
from corpuslens.operators import dedupe as D
from corpuslens.operators import labels as L
from corpuslens.operators import minhash as M
from corpuslens.operators import splits as SP
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import label3_fx, labeled_fx
from corpuslens.sources import sinks as W
from corpuslens.session import reliable_checkpoint
from corpuslens.sources.schemas import require_columns

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


LF = S.with_(S.LABELED_FX)


def flagship_label_share(spark, sf):
    """After removing duplicate texts, how is each label distributed per source?"""
    df = require_columns(labeled_fx(spark, sf), {"text", "label", "is_synth"})
    df = df.dropna(subset=["text", "label", "is_synth"])
    df = df.withColumn("label", L.strict_int(F.col("label"))).where(F.col("label").isin(0, 1))
    df = df.withColumn("text", normalize_basic(F.col("text")))
    df = D.dedupe_exact_first(df, "text", "doc_id")
    return L.shares(df, ["source"]).select("source", "label", "n", F.round("share", 6).alias("share"))


@register("label_share", LF + """
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labeled_fx WHERE is_synth = 0 GROUP BY label""")
def label_share(spark, sf):
    df = labeled_fx(spark, sf).where(F.col("is_synth") == 0)
    return L.shares(df, []).select("label", "n", F.round("share", 6).alias("share"))


@register("drop_null_required", LF + """
, holes AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 1 THEN text END AS text, CASE WHEN doc_id % 7 <> 2 THEN label END AS label,
                   CASE WHEN doc_id % 11 <> 3 THEN is_synth END AS is_synth FROM labeled_fx)
SELECT doc_id FROM holes WHERE text IS NOT NULL AND label IS NOT NULL AND is_synth IS NOT NULL""")
def drop_null_required(spark, sf):
    i = F.col("doc_id")
    holes = labeled_fx(spark, sf).select("doc_id", F.when(i % 5 != 1, F.col("text")).alias("text"),
                                         F.when(i % 7 != 2, F.col("label")).alias("label"),
                                         F.when(i % 11 != 3, F.col("is_synth")).alias("is_synth"))
    return holes.dropna(subset=["text", "label", "is_synth"]).select("doc_id")


@register("cast_labels", LF + """
SELECT doc_id, CAST(CAST(CAST(label AS VARCHAR) || '.0' AS DOUBLE) AS INTEGER) AS label FROM labeled_fx""")
def cast_labels(spark, sf):
    # labels arrive as text like '1.0' (a float column written to CSV); strict int cast truncates
    df = labeled_fx(spark, sf).select("doc_id", F.concat(F.col("label").cast("string"), F.lit(".0")).alias("raw"))
    return df.select("doc_id", L.strict_int(F.col("raw")).alias("label"))


@register("filter_label_domain", S.with_(S.LABEL3_FX) + "SELECT doc_id, label FROM label3_fx WHERE label IN (0, 1)")
def filter_label_domain(spark, sf):
    return label3_fx(spark, sf).where(F.col("label").isin(0, 1)).select("doc_id", "label")


@register("label_domain_violations", S.with_(S.LABEL3_FX) + """
SELECT DISTINCT label FROM label3_fx WHERE label NOT IN (0, 1)""")
def label_domain_violations(spark, sf):
    return L.domain_violations(label3_fx(spark, sf), "label", [0, 1])


@register("clip_flag", LF + """
SELECT doc_id, least(greatest(is_synth + label - 1 + (doc_id % 2)::INTEGER * 2, 0), 1) AS flag FROM labeled_fx""")
def clip_flag(spark, sf):
    raw = F.col("is_synth") + F.col("label") - 1 + (F.col("doc_id") % 2).cast("int") * 2
    return labeled_fx(spark, sf).select("doc_id", L.clip01(raw).alias("flag"))


@register("real_synth_counts", LF + """
SELECT count(*) FILTER (WHERE is_synth = 0) AS n_real, count(*) FILTER (WHERE is_synth = 1) AS n_synth,
       count(*) AS n_total FROM labeled_fx""")
def real_synth_counts(spark, sf):
    df = labeled_fx(spark, sf)
    return df.agg(F.count_if(F.col("is_synth") == 0).alias("n_real"),
                  F.count_if(F.col("is_synth") == 1).alias("n_synth"), F.count(F.lit(1)).alias("n_total"))


@register("class_weights", LF + """
, c AS (SELECT label, count(*) AS n_c FROM labeled_fx WHERE is_synth = 0 GROUP BY label)
SELECT label, n_c, round(sum(n_c) OVER () / (2 * n_c), 6) AS weight FROM c""")
def class_weights(spark, sf):
    real = labeled_fx(spark, sf).where(F.col("is_synth") == 0)
    return L.class_weights(real, [0, 1]).select("label", "n_c", F.round("weight", 6).alias("weight"))


SAMPLE_W_SQL = LF + """
, c AS (SELECT label, count(*) AS n_c FROM labeled_fx WHERE is_synth = 0 GROUP BY label),
cw AS (SELECT label, sum(n_c) OVER () / (2 * n_c) AS w FROM c)
SELECT f.doc_id, round(cw.w * CASE WHEN f.is_synth = 1 THEN 0.3 ELSE 1.0 END, 6) AS sample_weight
FROM labeled_fx f LEFT JOIN cw USING (label)"""


@register("sample_weights", SAMPLE_W_SQL)
def sample_weights(spark, sf):
    df = labeled_fx(spark, sf)
    cw = L.class_weights(df.where(F.col("is_synth") == 0), [0, 1])
    return L.sample_weights(df, cw, 0.3).select("doc_id", F.round("sample_weight", 6).alias("sample_weight"))


@register("sample_exact", LF + """
, s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|synth|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
               count(*) OVER () AS n FROM labeled_fx WHERE is_synth = 1)
SELECT doc_id FROM s WHERE rn <= round_even(n * CAST(0.5 AS DOUBLE), 0)""")
def sample_exact(spark, sf):
    synth = labeled_fx(spark, sf).where(F.col("is_synth") == 1).select("doc_id")
    return SP.sample_exact(synth, "doc_id", 0.5, 42)


@register("map_labels", S.with_(S.LABEL3_FX) + """
SELECT doc_id, label, CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 9 THEN 2 END AS label_internal,
       CASE label WHEN 0 THEN 'negatif' WHEN 1 THEN 'pozitif' WHEN 9 THEN 'alakasiz' END AS label_name
FROM label3_fx""")
def map_labels(spark, sf):
    from corpuslens.operators.scoring import NAMES_3, TO_INTERNAL, map_codes
    df = label3_fx(spark, sf)
    internal = map_codes(F.col("label"), TO_INTERNAL)
    return df.select("doc_id", "label", internal.alias("label_internal"),
                     map_codes(internal, NAMES_3).alias("label_name"))


@register("split_stratified", S.with_(S.LABEL3_FX) + """
, q AS (SELECT label, count(*) AS n FROM label3_fx GROUP BY label),
qq AS (SELECT label, round_even(n * CAST(0.15 AS DOUBLE), 0) AS nt,
              round_even((n - round_even(n * CAST(0.15 AS DOUBLE), 0)) * (CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE))), 0) AS nv FROM q),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|strat|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
      FROM label3_fx)
SELECT r.doc_id, r.label, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split
FROM r JOIN qq USING (label)""")
def split_stratified(spark, sf):
    df = label3_fx(spark, sf).select("doc_id", "label")
    return SP.split_stratified(df, "doc_id", "label", 0.15, 0.15, 42).select("doc_id", "label", "split")


# ---- leakage-free group split --------------------------------------------------------------

SPLIT_CTES = [S.LABELED_FX, """
real_fx AS (SELECT * FROM labeled_fx WHERE is_synth = 0)""",
              S.minhash_ctes("real_fx", "doc_id", "text", 5, 12).strip(),
              S.components_ctes("real_fx", "doc_id").strip(), """
tot AS (SELECT count(*) AS n FROM labeled_fx)""", """
tgt AS (SELECT greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) AS test_n,
               greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) AS val_n FROM tot)""", """
roots AS (SELECT DISTINCT root FROM comps)""", """
tr AS (SELECT root FROM (SELECT root, row_number() OVER (ORDER BY md5('42|test|' || CAST(root AS VARCHAR)), root) AS rn
                         FROM roots) x, tgt WHERE rn <= test_n)""", """
vr AS (SELECT root FROM (SELECT root, row_number() OVER (ORDER BY md5('42|val|' || CAST(root AS VARCHAR)), root) AS rn
                         FROM roots WHERE root NOT IN (SELECT root FROM tr)) x, tgt WHERE rn <= val_n)""", """
asg AS (SELECT f.doc_id, f.label, c.root,
               CASE WHEN c.root IN (SELECT root FROM tr) THEN 'test'
                    WHEN c.root IN (SELECT root FROM vr) THEN 'val' ELSE 'train' END AS split,
               0 AS is_synth
        FROM real_fx f JOIN comps c ON c.id = f.doc_id
        UNION ALL SELECT doc_id, label, NULL, 'train', is_synth FROM labeled_fx WHERE is_synth = 1)"""]
SPLIT_SQL = S.with_(*SPLIT_CTES)


def _split(spark, sf, signatures=None):
    return SP.split_groups(labeled_fx(spark, sf), "doc_id", "text", 0.10, 0.10, 42, signatures=signatures)


@register("split_groups", SPLIT_SQL + "SELECT doc_id, split, label, is_synth FROM asg")
def split_groups(spark, sf):
    return _split(spark, sf).select("doc_id", "split", "label", "is_synth")


@register("label_share_by_split", SPLIT_SQL + """
SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM asg GROUP BY split, label""")
def label_share_by_split(spark, sf):
    return L.shares(_split(spark, sf), ["split"]).select("split", "label", "n", F.round("share", 6).alias("share"))


@register("split_composition_cube", SPLIT_SQL + """
SELECT split, is_synth, count(*) AS n, grouping(split, is_synth) AS level FROM asg GROUP BY CUBE (split, is_synth)""")
def split_composition_cube(spark, sf):
    s = _split(spark, sf)
    return s.cube("split", "is_synth").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("split", "is_synth").alias("level"))


@register("assert_real_only", SPLIT_SQL + """
SELECT asg.split, count(*) AS n, count(*) FILTER (WHERE f.is_synth <> 0) AS synthetic
FROM asg JOIN labeled_fx f USING (doc_id) GROUP BY asg.split""")
def assert_real_only(spark, sf):
    """Rows and synthetic rows per split; the flag comes from the source, since the split sets its own in val and
    test. Train shows that the count does find synthetic rows."""
    s = _split(spark, sf).select("doc_id", "split")
    return (s.join(labeled_fx(spark, sf).select("doc_id", "is_synth"), "doc_id").groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_synth") != 0).alias("synthetic")))


SYNTH_KEEP = 0.3


@register("split_groups_synth_part", SPLIT_SQL + f"""
SELECT doc_id, split, label, is_synth FROM asg WHERE is_synth = 0
UNION ALL SELECT doc_id, split, label, is_synth FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42|synth|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM asg WHERE is_synth = 1)
  WHERE rn <= (SELECT round_even(count(*) * CAST({SYNTH_KEEP} AS DOUBLE), 0) FROM asg WHERE is_synth = 1)""")
def split_groups_synth_part(spark, sf):
    s = SP.split_groups(labeled_fx(spark, sf), "doc_id", "text", 0.10, 0.10, 42, synth_keep=SYNTH_KEEP)
    return s.select("doc_id", "split", "label", "is_synth")


@register("sink_partitioned_splits", SPLIT_SQL + "SELECT doc_id, label, is_synth, split FROM asg")
def sink_partitioned_splits(spark, sf):
    path = W.scratch_path(spark, "splits")
    W.write_splits(_split(spark, sf).select("doc_id", "label", "is_synth", "split"), path)
    # partition pruning: each read lists and reads the folder of its split only
    parts = [spark.read.parquet(path).where(F.col("split") == name) for name in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "label", "is_synth", "split")


LEAK_SQL = S.with_(*SPLIT_CTES, S.minhash_ctes("labeled_fx", "doc_id", "text", 5, 12, p="a_").strip(), """
role AS (SELECT doc_id AS id, CASE WHEN split = 'train' AND is_synth = 1 THEN 'synth'
                                   WHEN split IN ('val', 'test') THEN 'eval' END AS role FROM asg)""", """
b AS (SELECT a_bnd.band, a_bnd.key, a_bnd.id, role.role FROM a_bnd JOIN role USING (id))""", """
mixed AS (SELECT band, key FROM b GROUP BY band, key
          HAVING max(CASE WHEN role = 'synth' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN role = 'eval' THEN 1 ELSE 0 END) = 1)""") + """
SELECT 'clusters_spanning_splits' AS metric, count(*) AS value FROM
  (SELECT root FROM asg WHERE root IS NOT NULL GROUP BY root HAVING count(DISTINCT split) > 1) x
UNION ALL
SELECT 'synth_rows_near_eval', count(DISTINCT id) FROM b WHERE role = 'synth' AND (band, key) IN (SELECT band, key FROM mixed)"""


@register("leakage_audit", LEAK_SQL)
def leakage_audit(spark, sf):
    """Clusters spanning two splits, and synthetic train rows sharing an LSH bucket with val/test
    (the reference clusters real rows only, so such synthetic near-copies can leak)."""
    sigs = W.written(M.with_signatures(labeled_fx(spark, sf), "doc_id", "text", keep=("is_synth",)), "signatures")
    s = reliable_checkpoint(_split(spark, sf, sigs.where("is_synth = 0")).drop("text"))
    spans = (s.where(F.col("root").isNotNull()).groupBy("root").agg(F.count_distinct("split").alias("k"))
             .where(F.col("k") > 1).agg(F.count(F.lit(1)).alias("value"))
             .select(F.lit("clusters_spanning_splits").alias("metric"), "value"))
    bands = W.written(M.band_keys(sigs.select("id", "sig")), "bands")
    role = s.select(F.col("doc_id").alias("id"),
                    F.when((F.col("split") == "train") & (F.col("is_synth") == 1), "synth")
                    .when(F.col("split").isin("val", "test"), "eval").alias("role"))
    b = bands.join(role, "id")
    mixed = (b.groupBy("band", "key")
             .agg(F.max((F.col("role") == "synth").cast("int")).alias("has_s"),
                  F.max((F.col("role") == "eval").cast("int")).alias("has_e"))
             .where((F.col("has_s") == 1) & (F.col("has_e") == 1)))
    leaked = (b.where(F.col("role") == "synth").join(mixed.select("band", "key"), ["band", "key"], "left_semi")
              .agg(F.count_distinct("id").alias("value"))
              .select(F.lit("synth_rows_near_eval").alias("metric"), "value"))
    return spans.unionByName(leaked)


LEAK_ROWS_SQL = S.with_(*SPLIT_CTES, """
nw_all AS (SELECT doc_id AS id, """ + S.words(S.norm_minhash("text")) + """ AS w FROM labeled_fx),
hash_all AS (SELECT id, list_distinct(list_transform(""" + S.shingles("w") + ", lambda s: " + S.hash32("s") + f""")) AS hs FROM nw_all),
near AS (SELECT s.doc_id AS id, e.doc_id AS near_id, len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))) AS jaccard
         FROM asg s JOIN hash_all a ON a.id = s.doc_id, asg e JOIN hash_all b ON b.id = e.doc_id
         WHERE s.split = 'train' AND e.split IN ('val', 'test'))""") + f"""
SELECT id AS doc_id, arg_min(near_id, [-jaccard, near_id]) AS near_id, round(max(jaccard), 6) AS jaccard
FROM near WHERE jaccard >= {M.DEFAULT_THRESHOLD} GROUP BY id"""


@register("leakage_rows", LEAK_ROWS_SQL)
def leakage_rows(spark, sf):
    """Train rows, synthetic ones among them, with a near copy in val or test: verified similarity and the copy."""
    sets = W.written(M.shingle_sets(labeled_fx(spark, sf), "doc_id", "text", keep=("is_synth",)), "sets")
    s = reliable_checkpoint(_split(spark, sf, sets.where("is_synth = 0")).select(F.col("doc_id").alias("id"), "split"))
    found = M.nearest_across(sets, s.where(F.col("split") == "train"), s.where(F.col("split").isin("val", "test")))
    return found.select(F.col("id").alias("doc_id"), "near_id", F.round("jaccard", 6).alias("jaccard"))


SPLIT_ROWS_SQL = S.with_(*SPLIT_CTES[:6], """
roots AS (SELECT root, count(*) AS size FROM comps GROUP BY root)""", """
tr AS (SELECT root FROM (SELECT root, size, sum(size) OVER (ORDER BY md5('42|test|' || CAST(root AS VARCHAR)), root
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
                         FROM roots) x, tgt WHERE cum - size < test_n)""", """
vr AS (SELECT root FROM (SELECT root, size, sum(size) OVER (ORDER BY md5('42|val|' || CAST(root AS VARCHAR)), root
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
                         FROM roots WHERE root NOT IN (SELECT root FROM tr)) x, tgt WHERE cum - size < val_n)""",
                         SPLIT_CTES[-1])


@register("split_groups_rows", SPLIT_ROWS_SQL + "SELECT doc_id, split, label, is_synth FROM asg")
def split_groups_rows(spark, sf):
    """Row-target variant: whole clusters in seeded order until each split holds >= its row target."""
    s = SP.split_groups(labeled_fx(spark, sf), "doc_id", "text", 0.10, 0.10, 42, unit="rows")
    return s.select("doc_id", "split", "label", "is_synth")
