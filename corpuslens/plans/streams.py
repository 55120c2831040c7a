"""Registered streaming keys: each drains the events table through a streaming query and
returns the committed result (batch = stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.plans.fixtures import landed_pages_fx
from corpuslens.sources.sinks import scratch_path
from corpuslens.streaming import pages as PG
from corpuslens.streaming import streams as ST

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _events_stream(spark, sf):
    # the folder holds one file per table; a path glob restricts the stream to the events table
    return ST.read_stream(spark, sf, glob="events.parquet")


@register("stream_ingest", "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value FROM events")
def stream_ingest(spark, sf):
    s = _events_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                                         "event_type", "value")
    return ST.run_to_table(spark, s, "ingest")


@register("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    # one row per (user, event type): a long watermark keeps every key in state for the data span
    s = _events_stream(spark, sf).withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    d = ST.stream_dedupe(s, "k", "ts", "60 days").select("user_id", "event_type")
    return ST.run_to_table(spark, d, "dedupe")


@register("stream_tumbling", """
SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS window_start,
       time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY AS window_end,
       count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_pos,
       count(*) FILTER (WHERE event_type = 'error') AS n_neg
FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    t = ST.tumbling(_events_stream(spark, sf))
    out = ST.run_to_table(spark, t, "tumbling", mode="complete")
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_pos", "n_neg")


@register("stream_sliding", """
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events),
starts AS (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (k) DAY AS ws
           FROM e, range(0, 7) t(k))
SELECT s.ws AS window_start, s.ws + INTERVAL 7 DAY AS window_end, count(*) AS n, round(sum(e.value), 6) AS value_sum
FROM starts s JOIN e ON e.ts >= s.ws AND e.ts < s.ws + INTERVAL 7 DAY GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    t = ST.sliding(_events_stream(spark, sf))
    out = ST.run_to_table(spark, t, "sliding", mode="complete")
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                      F.round("value_sum", 6).alias("value_sum"))


# append mode: a window is final once the watermark (newest event less the delay) has reached its end
CLOSED = "(SELECT date_trunc('millisecond', max(CAST(ts AS TIMESTAMP))) - INTERVAL 1 DAY FROM events)"


@register("stream_tumbling_append", f"""
SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) AS window_start,
       time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 6 HOUR AS window_end,
       count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_pos,
       count(*) FILTER (WHERE event_type = 'error') AS n_neg
FROM events WHERE time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 6 HOUR <= {CLOSED} GROUP BY 1, 2""")
def stream_tumbling_append(spark, sf):
    t = ST.tumbling(_events_stream(spark, sf), size="6 hours", delay="1 day")
    out = ST.run_to_table(spark, t, "tumbling-append")
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_pos", "n_neg")


@register("stream_sessions", f"""
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
      FROM e),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f),
o AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n
      FROM g GROUP BY user_id, s)
SELECT * FROM o WHERE session_end <= {CLOSED}""")
def stream_sessions(spark, sf):
    out = ST.run_to_table(spark, ST.sessions(_events_stream(spark, sf)), "sessions")
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@register("stream_sessions_sliced", f"""
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
      FROM e),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f),
o AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n,
             time_bucket(INTERVAL 6 HOUR, max(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS border
      FROM g GROUP BY user_id, s)
SELECT user_id, session_start, session_end, n FROM o
WHERE CASE WHEN session_end < border THEN session_end <= {CLOSED} ELSE border + INTERVAL 7 HOUR <= {CLOSED} END""")
def stream_sessions_sliced(spark, sf):
    """The sessions of ``stream_sessions`` with a hot key's state dealt by time; those near an open border wait longer."""
    parts = ST.run_to_table(spark, ST.session_slices(_events_stream(spark, sf)), "session-parts")
    last = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).first().t
    # the watermark of a drained stream: the latest time, in whole milliseconds, less the delay
    whole = ST.join_slices(parts, (last // 1000) * 1000 - 86_400_000_000)
    return whole.select(F.col("key").alias("user_id"), F.timestamp_micros("first").alias("session_start"),
                        F.timestamp_micros(F.col("last") + 3_600_000_000).alias("session_end"), "n")


PAGES_LANDED = """
WITH t AS (SELECT conv_id, turn, turn // 2 AS p, max(turn // 2) OVER (PARTITION BY conv_id) AS last FROM conversations),
p AS (SELECT DISTINCT conv_id, p, last, (conv_id + p) % 6 = 0 AS twice, p < last AND (conv_id * 5 + p) % 19 = 7 AS forked
      FROM t WHERE (conv_id * 7 + p * 3) % 23 <> 5),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS rn FROM p)"""


def _fed_pages(spark, sf):
    """Pages that land out of order, twice, forked or never, taken in micro-batches."""
    landing = scratch_path(spark, "landing")
    landed_pages_fx(spark, sf).write.partitionBy("landing").json(landing)
    feed = PG.PageFeed(spark, scratch_path(spark, "feed"))
    stream = ST.read_stream(spark, landing, PG.PAGE, "json", max_files=24)
    feed.drain(stream, scratch_path(spark, "feed-ckpt"))
    return feed


@register("page_chain_posts", PAGES_LANDED + """
SELECT 'q' || CAST(r.conv_id AS VARCHAR) AS chain, r.p AS page_rank,
       CAST(row_number() OVER (PARTITION BY r.conv_id, r.p ORDER BY turn) - 1 AS INTEGER) AS pos,
       CAST(r.conv_id * 1000 + turn AS VARCHAR) AS id, text
FROM r JOIN t USING (conv_id, p) JOIN conversations USING (conv_id, turn) WHERE rn = r.p""")
def page_chain_posts(spark, sf):
    return _fed_pages(spark, sf).posts().select("chain", "page_rank", "pos", "id", "text")


@register("page_chain_report", PAGES_LANDED + """
SELECT 'q' || CAST(conv_id AS VARCHAR) AS chain, count(*) + count(*) FILTER (WHERE twice) + count(*) FILTER (WHERE forked) AS landed,
       count(*) FILTER (WHERE twice) AS repeats, count(*) FILTER (WHERE forked) AS forks,
       count(*) FILTER (WHERE p < last AND (conv_id, p + 1) NOT IN (SELECT (conv_id, p) FROM r)) AS gaps,
       count(*) FILTER (WHERE rn = p) AS emitted, count(*) FILTER (WHERE rn <> p) AS waiting FROM r GROUP BY conv_id""")
def page_chain_report(spark, sf):
    return _fed_pages(spark, sf).report()
