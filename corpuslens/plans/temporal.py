"""Registered keys for time-based analytics over predicted labels and the event stream table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.operators import temporal as TM
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import metric_log_fx, sentiment_fx
from corpuslens.sources.tables import table

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SX = S.with_(S.SENTIMENT_FX)


@register("sentiment_insights_rollup", SX + """
SELECT university, tags, count(*) AS n, grouping(university, tags) AS level,
       round(count(*) / sum(count(*)) FILTER (WHERE grouping(university, tags) = 3) OVER (), 6) AS share_of_all
FROM sentiment_fx GROUP BY ROLLUP (university, tags)""")
def sentiment_insights_rollup(spark, sf):
    s = sentiment_fx(spark, sf)
    r = s.rollup("university", "tags").agg(F.count(F.lit(1)).alias("n"),
                                           F.grouping_id("university", "tags").alias("level"))
    total = s.count()  # one scalar
    return r.withColumn("share_of_all", F.round(F.col("n") / F.lit(total), 6))


DAILY_SQL = SX + """
, d AS (SELECT CAST(ts AS DATE) AS day, tags FROM sentiment_fx),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
c AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE tags = 1) AS n_pos, count(*) FILTER (WHERE tags = 0) AS n_neg
      FROM d GROUP BY day),
daily AS (SELECT cal.day, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg,
                 CASE WHEN coalesce(n_pos, 0) + coalesce(n_neg, 0) = 0 THEN NULL
                      ELSE n_pos / (n_pos + n_neg) END AS pos_share
          FROM cal LEFT JOIN c USING (day))"""


@register("volume_by_period", DAILY_SQL + "SELECT day, n, n_pos, n_neg, round(pos_share, 6) AS pos_share FROM daily")
def volume_by_period(spark, sf):
    d = TM.daily_volume(sentiment_fx(spark, sf))
    return d.select("day", "n", "n_pos", "n_neg", F.round("pos_share", 6).alias("pos_share"))


@register("volume_spikes", DAILY_SQL + """
, b AS (SELECT *, avg(n) OVER w AS base_mean, stddev_samp(n) OVER w AS base_sd FROM daily
        WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN base_sd IS NULL OR base_sd = 0 THEN NULL ELSE (n - base_mean) / base_sd END AS z FROM b)
SELECT day, n, round(base_mean, 6) AS base_mean, round(base_sd, 6) AS base_sd, round(z, 6) AS z,
       coalesce(z > 2.0, false) AS is_spike FROM z""")
def volume_spikes(spark, sf):
    sp = TM.spikes(TM.daily_volume(sentiment_fx(spark, sf)), lookback=7, z=2.0)
    return sp.select("day", "n", F.round("base_mean", 6).alias("base_mean"), F.round("base_sd", 6).alias("base_sd"),
                     F.round("z", 6).alias("z"), "is_spike")


@register("sentiment_trend", DAILY_SQL + """
SELECT day, round(pos_share, 6) AS pos_share,
       round(pos_share - lag(pos_share) OVER (ORDER BY day), 6) AS share_change,
       round(avg(pos_share) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS share_rolling
FROM daily""")
def sentiment_trend(spark, sf):
    t = TM.trend(TM.daily_volume(sentiment_fx(spark, sf)), window=7)
    return t.select("day", F.round("pos_share", 6).alias("pos_share"), F.round("share_change", 6).alias("share_change"),
                    F.round("share_rolling", 6).alias("share_rolling"))


@register("heatmap_pivot", SX + """
SELECT university, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM sentiment_fx GROUP BY ALL""")
def heatmap_pivot(spark, sf):
    # long form: every ISO week of every year has its row, whatever weeks the data hold
    year = F.extract(F.lit("YEAROFWEEK"), F.col("ts"))
    week = F.format_string("%04d-W%02d", year, F.weekofyear("ts"))
    return sentiment_fx(spark, sf).groupBy("university", week.alias("week")).agg(F.count(F.lit(1)).alias("n"))


PHASES = [("early", "2024-01-01", "2024-01-10"), ("mid", "2024-01-10", "2024-01-20"), ("late", "2024-01-20", "2024-02-01")]


@register("phase_comparison", SX + """
, ph AS (SELECT * FROM (VALUES ('early', DATE '2024-01-01', DATE '2024-01-10'), ('mid', DATE '2024-01-10', DATE '2024-01-20'),
                               ('late', DATE '2024-01-20', DATE '2024-02-01')) t(phase, s, e))
SELECT ph.phase, count(*) AS n, count(*) FILTER (WHERE tags = 1) AS n_pos,
       round(count(*) FILTER (WHERE tags = 1) / nullif(count(*) FILTER (WHERE tags IN (0, 1)), 0), 6) AS pos_share,
       round(avg(value), 6) AS avg_value
FROM sentiment_fx f JOIN ph ON CAST(f.ts AS DATE) >= ph.s AND CAST(f.ts AS DATE) < ph.e GROUP BY ph.phase""")
def phase_comparison(spark, sf):
    s = sentiment_fx(spark, sf).select(F.explode_outer(TM.assign_phases(F.col("ts"), PHASES)).alias("phase"),
                                       "tags", "value").where(F.col("phase").isNotNull())
    g = s.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tags") == 1).alias("n_pos"),
                               F.count_if(F.col("tags").isin(0, 1)).alias("_n01"), F.avg("value").alias("avg_value"))
    share = F.when(F.col("_n01") == 0, F.lit(None)).otherwise(F.col("n_pos") / F.col("_n01"))
    return g.select("phase", "n", "n_pos", F.round(share, 6).alias("pos_share"), F.round("avg_value", 6).alias("avg_value"))


@register("phase_overlaps", SX + """
, u AS (SELECT user_id, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, value FROM events),
ph AS (SELECT user_id AS phase, min(day) AS s, max(day) + 1 AS e FROM u GROUP BY user_id)
SELECT phase, count(*) AS n, round(avg(value), 6) AS avg_value FROM u JOIN ph ON u.day >= ph.s AND u.day < ph.e GROUP BY phase""")
def phase_overlaps(spark, sf):
    """Volume in each user's own span of days, from the first to the last of all their events: as many overlapping
    phases as there are users."""
    ev = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    day = F.to_date("ts")
    spans = (ev.groupBy(F.col("user_id").alias("phase"))
             .agg(F.min(day).alias("start"), F.date_add(F.max(day), 1).alias("end")))
    found = TM.phase_volumes(ev, spans, "ts", "value")
    return found.select("phase", "n", F.round("avg_value", 6).alias("avg_value"))


@register("session_bursts", SX + """
, o AS (SELECT university, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY university ORDER BY ts, event_id) < INTERVAL 30 MINUTE
                                   THEN 0 ELSE 1 END AS brk, event_id FROM sentiment_fx),
g AS (SELECT university, ts, sum(brk) OVER (PARTITION BY university ORDER BY ts, event_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT university, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n
FROM g GROUP BY university, sid""")
def session_bursts(spark, sf):
    # same sessions as groupBy(university, session_window(ts, "30 minutes")), but split by day so a
    # hot institution is not sorted in a single task
    return TM.sessionize(sentiment_fx(spark, sf), "university", "ts", 30 * 60, bucket="hour")


@register("nearest_event_join", """
WITH l AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'click'),
r AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'view'),
m AS (SELECT l.event_id AS left_id,
             arg_min(r.event_id, [abs(epoch_us(l.ts) - epoch_us(r.ts)), epoch_us(r.ts), r.event_id]) AS right_id
      FROM l LEFT JOIN r ON r.user_id = l.user_id GROUP BY l.event_id)
SELECT m.left_id, m.right_id, epoch_us(l.ts) - epoch_us(r.ts) AS gap_us
FROM m JOIN l ON l.event_id = m.left_id LEFT JOIN r ON r.event_id = m.right_id""")
def nearest_event_join(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    left = ev.where(F.col("event_type") == "click")
    right = ev.where(F.col("event_type") == "view")
    return TM.nearest_join(left, right, "user_id", "ts", "event_id")


LOG_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in ("epoch", "loss", "eval_loss", "eval_macro_f1")])


@register("metric_log_series", """
WITH r AS (SELECT event_id, event_type, floor(epoch(CAST(ts AS TIMESTAMP))) / 86400.0 AS epoch, value
           FROM events WHERE event_type IN ('view', 'click'))
SELECT event_id, 'train_loss' AS series, round(epoch, 6) AS epoch, round(value, 6) AS value FROM r WHERE event_type = 'view'
UNION ALL SELECT event_id, 'val_loss', round(epoch, 6), round(value, 6) FROM r WHERE event_type = 'click'
UNION ALL SELECT event_id, 'val_macro_f1', round(epoch, 6), round(value / 50.0, 6) FROM r
          WHERE event_type = 'click' AND event_id % 2 = 0""")
def metric_log_series(spark, sf):
    lg = metric_log_fx(spark, sf).select("event_id", F.from_json("record", LOG_SCHEMA).alias("r")).select("event_id", "r.*")
    train = lg.where(F.col("loss").isNotNull() & F.col("eval_loss").isNull()) \
        .select("event_id", F.lit("train_loss").alias("series"), "epoch", F.col("loss").alias("value"))
    val = lg.where(F.col("eval_loss").isNotNull()) \
        .select("event_id", F.lit("val_loss").alias("series"), "epoch", F.col("eval_loss").alias("value"))
    f1 = lg.where(F.col("eval_loss").isNotNull() & F.col("eval_macro_f1").isNotNull()) \
        .select("event_id", F.lit("val_macro_f1").alias("series"), "epoch", F.col("eval_macro_f1").alias("value"))
    out = train.unionByName(val).unionByName(f1)
    return out.select("event_id", "series", F.round("epoch", 6).alias("epoch"), F.round("value", 6).alias("value"))
