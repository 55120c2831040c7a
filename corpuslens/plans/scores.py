"""Registered keys over model scores: sweep, best threshold, reports, losses, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.arrays import argmax, softmax
from corpuslens.operators import evaluate as E
from corpuslens.operators import labels as L
from corpuslens.operators import scoring as SC
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import logits3_fx, scores_fx
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


STEP, NGRID = 0.005, 200
SF = S.with_(S.SCORES_FX)
# brute force: every grid threshold against every real row
SWEEP_SQL = SF + f"""
, grid AS (SELECT k, k * CAST({STEP} AS DOUBLE) AS threshold FROM range(0, {NGRID}) t(k)),
cnt AS (
  SELECT g.k, g.threshold,
         count(*) FILTER (WHERE s.y = 1 AND s.prob_pos >= g.threshold) AS tp,
         count(*) FILTER (WHERE s.y = 0 AND s.prob_pos >= g.threshold) AS fp,
         count(*) FILTER (WHERE s.y = 1 AND s.prob_pos < g.threshold) AS fn,
         count(*) FILTER (WHERE s.y = 0 AND s.prob_pos < g.threshold) AS tn
  FROM grid g, scores_fx s WHERE s.is_synth = 0 GROUP BY g.k, g.threshold),
mf AS (SELECT *, (CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END
                 + CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END) / 2 AS macro_f1
       FROM cnt)"""


def _sweep(spark, sf):
    real = scores_fx(spark, sf).where(F.col("is_synth") == 0)
    return E.threshold_sweep(real, "prob_pos", "y", 0.0, STEP, NGRID)


@register("threshold_sweep", SWEEP_SQL + """
SELECT k, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(macro_f1, 6) AS macro_f1 FROM mf""")
def threshold_sweep(spark, sf):
    s = _sweep(spark, sf)
    return s.select("k", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn",
                    F.round("macro_f1", 6).alias("macro_f1"))


BEST_SQL = SWEEP_SQL + ", best AS (SELECT threshold, macro_f1 FROM mf ORDER BY macro_f1 DESC, k LIMIT 1)\n"


@register("best_threshold", BEST_SQL + "SELECT round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1 FROM best")
def best_threshold(spark, sf):
    b = E.best_threshold(_sweep(spark, sf))
    return b.select(F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))


def _best_value(spark, sf) -> float:
    # a single scalar travels to the driver and back as a literal
    return E.best_threshold(_sweep(spark, sf)).first()["threshold"]


@register("threshold_apply", BEST_SQL + """
SELECT s.vec_id, s.y, CASE WHEN s.prob_pos >= b.threshold THEN 1 ELSE 0 END AS y_pred FROM scores_fx s, best b""")
def threshold_apply(spark, sf):
    thr = _best_value(spark, sf)
    s = scores_fx(spark, sf)
    return s.select("vec_id", "y", (F.col("prob_pos") >= F.lit(thr)).cast("int").alias("y_pred"))


@register("confusion_matrix", SF + """
, cells AS (SELECT a.y, b.y_pred FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(y_pred)),
c AS (SELECT y, CASE WHEN prob_pos >= 0.5 THEN 1 ELSE 0 END AS y_pred, count(*) AS n FROM scores_fx GROUP BY ALL)
SELECT cells.y, cells.y_pred, coalesce(c.n, 0) AS n FROM cells LEFT JOIN c USING (y, y_pred)""")
def confusion_matrix(spark, sf):
    s = scores_fx(spark, sf).withColumn("y_pred", (F.col("prob_pos") >= 0.5).cast("int"))
    return E.confusion_matrix(s, "y", "y_pred", [0, 1])


REPORT_SQL = """
per AS (SELECT label,
               count(*) FILTER (WHERE y = label) AS support,
               count(*) FILTER (WHERE y = label AND y_pred = label) AS tp,
               count(*) FILTER (WHERE y_pred = label) AS predicted
        FROM lab, p GROUP BY label),
m AS (SELECT label, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc, tp FROM per),
f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf,
               sum(pr * support) / sum(support) AS wp, sum(rc * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM f)
SELECT CAST(label AS VARCHAR) AS "row", round(pr, 4) AS precision, round(rc, 4) AS recall, round(f1, 4) AS f1_score,
       support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 4), n::BIGINT FROM tot
UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), n::BIGINT FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 4), round(wr, 4), round(wf, 4), n::BIGINT FROM tot"""


@register("classification_report", SF + """
, p AS (SELECT y, CASE WHEN prob_pos >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM scores_fx),
lab AS (SELECT * FROM (VALUES (0), (1)) t(label)),""" + REPORT_SQL)
def classification_report(spark, sf):
    s = scores_fx(spark, sf).withColumn("y_pred", (F.col("prob_pos") >= 0.5).cast("int"))
    return E.classification_report(s, "y", "y_pred", [0, 1])


L3 = S.with_(S.LOGITS3_FX)


@register("softmax_scores", L3 + """
, m AS (SELECT vec_id, logits, list_max(logits) AS zm FROM logits3_fx),
e AS (SELECT vec_id, exp(logits[1] - zm) AS e0, exp(logits[2] - zm) AS e1, exp(logits[3] - zm) AS e2 FROM m)
SELECT vec_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1,
       round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e""")
def softmax_scores(spark, sf):
    p = logits3_fx(spark, sf).select("vec_id", softmax(F.col("logits")).alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


ARGMAX_SQL = L3 + """
, m AS (SELECT vec_id, y, logits, list_max(logits) AS zm FROM logits3_fx),
e AS (SELECT vec_id, y, exp(logits[1] - zm) AS e0, exp(logits[2] - zm) AS e1, exp(logits[3] - zm) AS e2 FROM m),
p AS (SELECT vec_id, y, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e),
a AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred,
             greatest(p0, p1, p2) AS pmax FROM p)"""


@register("argmax_class", ARGMAX_SQL + "SELECT vec_id, pred, round(pmax, 6) AS pmax FROM a")
def argmax_class(spark, sf):
    p = logits3_fx(spark, sf).select("vec_id", softmax(F.col("logits")).alias("p"))
    p = p.select("vec_id", argmax(F.col("p")).alias("pred"), F.array_max("p").alias("pmax"))
    return p.select("vec_id", "pred", F.round("pmax", 6).alias("pmax"))


def _three_classes(spark, sf):
    return logits3_fx(spark, sf).select("y", argmax(softmax(F.col("logits"))).alias("y_pred"))


@register("confusion_matrix_3class", ARGMAX_SQL + """
, cells AS (SELECT a.y, b.y_pred FROM (VALUES (0), (1), (2)) a(y), (VALUES (0), (1), (2)) b(y_pred)),
c AS (SELECT y, pred AS y_pred, count(*) AS n FROM a GROUP BY ALL)
SELECT cells.y, cells.y_pred, coalesce(c.n, 0) AS n FROM cells LEFT JOIN c USING (y, y_pred)""")
def confusion_matrix_3class(spark, sf):
    return E.confusion_matrix(_three_classes(spark, sf), "y", "y_pred", [0, 1, 2])


@register("classification_report_3class", "WITH p AS (" + ARGMAX_SQL + """ SELECT y, pred AS y_pred FROM a),
lab AS (SELECT * FROM (VALUES (0), (1), (2)) t(label)),""" + REPORT_SQL)
def classification_report_3class(spark, sf):
    return E.classification_report(_three_classes(spark, sf), "y", "y_pred", [0, 1, 2])


@register("abstain_low_confidence", ARGMAX_SQL + f"""
, x AS (SELECT vec_id, CASE pred WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 9 END AS ext, pmax FROM a)
SELECT vec_id, ext AS pred, CASE WHEN ext IN (0, 1) AND pmax < {SC.DEFAULT_ABSTAIN} THEN 9 ELSE ext END AS tags FROM x""")
def abstain_low_confidence(spark, sf):
    lab = SC.label_from_logits(logits3_fx(spark, sf))
    return lab.select("vec_id", F.col("pred"), "tags")


LOSS_SQL = S.with_(S.LOGITS3_FX) + """
, b AS (SELECT vec_id, y, logits, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS is_synth, list_max(logits) AS zm FROM logits3_fx),
c AS (SELECT y, count(*) AS n_c FROM b WHERE is_synth = 0 GROUP BY y),
cw AS (SELECT y, sum(n_c) OVER () / (3 * n_c) AS w FROM c),
r AS (SELECT b.*, cw.w * CASE WHEN is_synth = 1 THEN 0.3 ELSE 1.0 END AS sw,
             zm + ln(exp(logits[1] - zm) + exp(logits[2] - zm) + exp(logits[3] - zm)) - logits[y + 1] AS nll
      FROM b JOIN cw USING (y))
SELECT round(sum(nll * sw) / count(*), 6) AS loss_mean_n, round(sum(nll * sw) / sum(sw), 6) AS loss_mean_w FROM r"""


@register("weighted_log_loss", LOSS_SQL)
def weighted_log_loss(spark, sf):
    df = logits3_fx(spark, sf).withColumn("is_synth", F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)) \
        .withColumnRenamed("y", "label")
    cw = L.class_weights(df.where(F.col("is_synth") == 0), [0, 1, 2])
    w = L.sample_weights(df, cw, 0.3)
    loss = L.weighted_log_loss(w, F.col("logits"), F.col("label"), F.col("sample_weight"))
    return loss.select(F.round("loss_mean_n", 6).alias("loss_mean_n"), F.round("loss_mean_w", 6).alias("loss_mean_w"))


@register("run_bundle", BEST_SQL + """
, c AS (SELECT y, count(*) AS n_c FROM scores_fx WHERE is_synth = 0 GROUP BY y),
cw AS (SELECT max(CASE WHEN y = 0 THEN sum_n / (2 * n_c) END) AS w0, max(CASE WHEN y = 1 THEN sum_n / (2 * n_c) END) AS w1
       FROM (SELECT y, n_c, sum(n_c) OVER () AS sum_n FROM c) t)
SELECT round(b.threshold, 6) AS threshold, round(b.macro_f1, 6) AS val_macro_f1, CAST(0.3 AS DOUBLE) AS synth_weight,
       round(cw.w0, 6) AS w0, round(cw.w1, 6) AS w1 FROM best b, cw""")
def run_bundle(spark, sf):
    best = E.best_threshold(_sweep(spark, sf)).first()
    real = scores_fx(spark, sf).where(F.col("is_synth") == 0).withColumnRenamed("y", "label")
    cw = L.class_weights(real, [0, 1]).orderBy("label").select("weight")
    w = [r["weight"] for r in cw.collect()]  # two scalars
    one = spark.createDataFrame([(best["threshold"], best["macro_f1"], 0.3, w)],
                                "threshold double, val_macro_f1 double, synth_weight double, class_weights_real_train array<double>")
    path = W.scratch_path(spark, "bundle")
    W.run_bundle(one).write.mode("overwrite").text(path)
    back = spark.read.schema("threshold double, val_macro_f1 double, synth_weight double, "
                             "class_weights_real_train array<double>").json(path)
    return back.select(F.round("threshold", 6).alias("threshold"), F.round("val_macro_f1", 6).alias("val_macro_f1"),
                       "synth_weight", F.round(F.col("class_weights_real_train")[0], 6).alias("w0"),
                       F.round(F.col("class_weights_real_train")[1], 6).alias("w1"))


@register("model_agreement", """
WITH a AS (SELECT vec_id, CASE WHEN 1.0 / (1.0 + exp(-8.0 * CAST(embedding[1] AS DOUBLE))) >= 0.5 THEN 1 ELSE 0 END AS p
           FROM embeddings),
b AS (SELECT vec_id, CASE WHEN 1.0 / (1.0 + exp(-8.0 * CAST(embedding[2] AS DOUBLE))) >= 0.5 THEN 1 ELSE 0 END AS p
      FROM embeddings)
SELECT a.p AS pred_a, b.p AS pred_b, count(*) AS n FROM a JOIN b USING (vec_id) GROUP BY ALL""")
def model_agreement(spark, sf):
    from corpuslens.sources.tables import table
    e = table(spark, sf, "embeddings")

    def model(i):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * F.col("embedding")[i].cast("double")))
        return e.select("vec_id", (p >= 0.5).cast("int").alias(f"p{i}"))
    j = model(0).join(model(1), "vec_id")
    return j.groupBy(F.col("p0").alias("pred_a"), F.col("p1").alias("pred_b")).agg(F.count(F.lit(1)).alias("n"))


# second grid of the reference: 91 thresholds 0.05, 0.06, ..., 0.95
LIN_START, LIN_STEP, LIN_N = 0.05, 0.01, 91


@register("threshold_sweep_linspace", SF + f"""
, grid AS (SELECT k, CAST({LIN_START} AS DOUBLE) + k * CAST({LIN_STEP} AS DOUBLE) AS threshold FROM range(0, {LIN_N}) t(k)),
cnt AS (
  SELECT g.k, g.threshold,
         count(*) FILTER (WHERE s.y = 1 AND s.prob_pos >= g.threshold) AS tp,
         count(*) FILTER (WHERE s.y = 0 AND s.prob_pos >= g.threshold) AS fp,
         count(*) FILTER (WHERE s.y = 1 AND s.prob_pos < g.threshold) AS fn,
         count(*) FILTER (WHERE s.y = 0 AND s.prob_pos < g.threshold) AS tn
  FROM grid g, scores_fx s WHERE s.is_synth = 0 GROUP BY g.k, g.threshold)
SELECT k, round(threshold, 6) AS threshold, tp, fp, fn, tn,
       round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END
            + CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END) / 2, 6) AS macro_f1
FROM cnt""")
def threshold_sweep_linspace(spark, sf):
    real = scores_fx(spark, sf).where(F.col("is_synth") == 0)
    s = E.threshold_sweep(real, "prob_pos", "y", LIN_START, LIN_STEP, LIN_N)
    return s.select("k", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn",
                    F.round("macro_f1", 6).alias("macro_f1"))
