"""Socio-temporal analytics: rollups, calendars, pivots, phases, spikes, trends, sessions and
the nearest-key (as-of, both directions) join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.joins import salted_join
from corpuslens.sources.sinks import written


def daily_volume(df: DataFrame, ts: str = "ts", label: str = "tags", by: list[str] | None = None) -> DataFrame:
    """Per day (and group): volume, negative/positive counts and positive share among 0/1 labels,
    zero-filled over a calendar spanning the data (one row per day, derived from min/max)."""
    by = by or []
    d = df.select(*by, F.to_date(ts).alias("day"), F.col(label).alias("_l"))
    counts = d.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.col("_l") == 1).alias("n_pos"),
                                       F.count_if(F.col("_l") == 0).alias("n_neg"))
    # calendar from the data's own span per group: explode(sequence(lo, hi)), no join needed
    cal = (d.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
           .select(*by, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day")))
    out = cal.join(counts, [*by, "day"], "left").fillna(0, ["n", "n_pos", "n_neg"])
    share = F.when(F.col("n_pos") + F.col("n_neg") == 0, F.lit(None).cast("double")) \
        .otherwise(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    return out.withColumn("pos_share", share)


def spikes(daily: DataFrame, by: list[str] | None = None, lookback: int = 7, z: float = 2.0) -> DataFrame:
    """Volume against the trailing baseline (mean and sample σ of the preceding ``lookback`` days)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(-lookback, -1)
    out = (daily.withColumn("base_mean", F.avg("n").over(w))
           .withColumn("base_sd", F.stddev_samp("n").over(w)))
    zs = F.when(F.col("base_sd").isNull() | (F.col("base_sd") == 0), F.lit(None).cast("double")) \
        .otherwise((F.col("n") - F.col("base_mean")) / F.col("base_sd"))
    return out.withColumn("z", zs).withColumn("is_spike", F.coalesce(F.col("z") > z, F.lit(False)))


def trend(daily: DataFrame, by: list[str] | None = None, window: int = 7) -> DataFrame:
    """Day-over-day change and rolling mean of the positive share."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("day")
    return (daily.withColumn("share_change", F.col("pos_share") - F.lag("pos_share").over(w))
            .withColumn("share_rolling", F.avg("pos_share").over(w.rowsBetween(-(window - 1), 0))))


def assign_phases(ts: Column, phases: list[tuple[str, str, str]]) -> Column:
    """Array of phase names whose ``[start, end)`` contains ``ts`` (phases are a small parameter
    list, so this is an expression, not a join)."""
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(dt.date.fromisoformat(s)).alias("s"),
                             F.lit(dt.date.fromisoformat(e)).alias("e")) for n, s, e in phases])
    d = F.to_date(ts)
    return F.transform(F.filter(arr, lambda p: (d >= p["s"]) & (d < p["e"])), lambda p: p["name"])


PHASE_CELL_DAYS = 16
HOT_CELL = 100_000  # events of one calendar cell from which they are dealt over sub-keys


def phase_join(events: DataFrame, phases: DataFrame, ts: str, cell_days: int = PHASE_CELL_DAYS,
               hot_rows: int = HOT_CELL) -> DataFrame:
    """The columns of ``events`` once for each row of ``phases(phase, start, end)`` whose ``[start, end)``, in days,
    contains the day of ``ts``, with ``phase``. Events in no phase are left out, as are empty and open phases
    (a null end) and events without a time.

    Phases may be thousands and overlap. Each is cut into calendar cells of ``cell_days``; events join the cells by
    equality and the exact test comes after, so neither a list of phases nor a range join is needed. An event
    lies in one cell, so a phase finds it once."""
    day = F.datediff(F.to_date(F.col(ts)), F.lit(dt.date(1970, 1, 1)))
    cell = lambda c: F.floor(c / F.lit(cell_days))
    e = events.withColumn("_day", day).where("_day is not null").withColumn("_cell", cell(F.col("_day")))
    p = phases.select(F.col("phase").alias("_phase"),
                      *[F.datediff(F.to_date(F.col(c)), F.lit(dt.date(1970, 1, 1))).alias(n) for c, n in (("start", "_s"), ("end", "_e"))])
    p = p.where("_s < _e").withColumn("_cell", F.explode(F.sequence(cell(F.col("_s")), cell(F.col("_e") - 1))))
    hot = e.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > hot_rows).select("_cell")
    both = salted_join(e, p, ["_cell"], hot, 64, F.xxhash64(F.col(ts), F.monotonically_increasing_id()))
    found = both.where("_day >= _s and _day < _e")
    return found.select(*[F.col(f"`{c}`") for c in events.columns], F.col("_phase").alias("phase"))


def phase_volumes(events: DataFrame, phases: DataFrame, ts: str, value: str, cell_days: int = PHASE_CELL_DAYS) -> DataFrame:
    """``phase, n, avg_value`` of the events in each row of ``phases(phase, start, end)``; phases without events are left out.

    An event counts in as many phases as hold its day, so events times phases would be joined one by one. They are
    added up by day first; the days join the distinct spans, and the spans' sums go to all phases that have them.
    So the work is that of the events, of the phases, and of the pairs of day and span in the calendar."""
    daily = events.groupBy(F.to_date(F.col(ts)).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_m"), F.sum(value).alias("_v"))
    spans = phases.select("phase", F.to_date("start").alias("_s"), F.to_date("end").alias("_e"))
    distinct = spans.select(F.struct("_s", "_e").alias("phase"), F.col("_s").alias("start"), F.col("_e").alias("end")).distinct()
    sums = (phase_join(written(daily, "days"), distinct, "_at", cell_days).groupBy("phase")
            .agg(*[F.sum(c).alias(c) for c in ("_n", "_m", "_v")]).select("phase._s", "phase._e", "_n", "_m", "_v"))
    hot = spans.groupBy("_s", "_e").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > HOT_CELL).select("_s", "_e")
    found = salted_join(spans, sums, ["_s", "_e"], hot, 64, F.xxhash64("phase"))
    return (found.groupBy("phase").agg(*[F.sum(c).alias(c) for c in ("_n", "_m", "_v")])
            .select("phase", F.col("_n").alias("n"), F.try_divide("_v", "_m").alias("avg_value")))


def nearest_join(left: DataFrame, right: DataFrame, by: str, ts: str, id_col: str,
                 num_partitions: int | None = None) -> DataFrame:
    """For each left row the right row (same ``by``) with the least |Δts|; ties → earlier right
    row, then smaller id. Emits ``left_id, right_id, gap_us = left.ts − right.ts``; a left row without a key, a time
    or a right row of its key has nulls.

    Exact without a theta join, and without any fixed time bucket: the union of both sides is cut by range over
    (key, time, row), so that one key's rows, be they of one hour or one instant, spread over as many tasks as
    their number asks for. Inside a range a running maximum and minimum over the rows in order find the right
    rows before and after; one row per range carries the neighbours across the borders."""
    placed = _in_ranges(left, right, by, ts, id_col, num_partitions)
    order = [F.col(c) for c in ("k", "t", "side", "rid", "lid")]
    right_row = F.col("side") == 0
    before = F.when(right_row, F.struct("k", "t", (-F.col("rid")).alias("nid")))
    after = F.when(right_row, F.struct("k", "t", "rid"))
    forth = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_pid").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = (placed.withColumns({"prev": F.max(before).over(forth), "next": F.min(after).over(back)})
             .where(F.col("side") == 1))
    ends = placed.groupBy("_pid").agg(F.max(before).alias("last"), F.min(after).alias("first"))  # one row a range
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_pid", F.max("last").over(earlier).alias("p_out"), F.min("first").over(later).alias("n_out"))
    found = found.join(F.broadcast(carried), "_pid", "left")
    # in the order of keys, the nearest right row before or after is of this key, or the key has none there
    prev, nxt = F.greatest("prev", "p_out"), F.least("next", "n_out")
    d_prev = F.when(prev["k"] == F.col("k"), F.col("t") - prev["t"])
    d_next = F.when(nxt["k"] == F.col("k"), nxt["t"] - F.col("t"))
    take_prev = d_prev.isNotNull() & (d_next.isNull() | (d_prev <= d_next))
    rid = F.when(take_prev, -prev["nid"]).when(d_next.isNotNull(), nxt["rid"])
    gap = F.when(take_prev, d_prev).otherwise(-d_next)
    alone = left.where(F.col(by).isNull() | F.col(ts).isNull()).select(
        F.col(id_col).alias("left_id"), *[F.lit(None).cast("long").alias(c) for c in ("right_id", "gap_us")])
    return found.select(F.col("lid").alias("left_id"), rid.alias("right_id"), gap.alias("gap_us")).unionByName(alone)


def _in_ranges(left: DataFrame, right: DataFrame, by: str, ts: str, id_col: str, num_partitions: int | None) -> DataFrame:
    """Both sides with key and time, ``k, t, side, lid, rid``, and the number ``_pid`` of their range; written once,
    since range bounds are sampled."""
    def rows(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        return (df.where(F.col(by).isNotNull() & F.col(ts).isNotNull())
                .select(F.col(by).alias("k"), F.unix_micros(F.col(ts)).alias("t"), F.lit(side).alias("side"),
                        F.col(id_col).cast("long").alias(own), F.lit(None).cast("long").alias(other)))

    union = rows(left, 1, "lid", "rid").unionByName(rows(right, 0, "rid", "lid"))
    n = num_partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(union.repartitionByRange(n, "k", "t", "side", "rid", "lid").withColumn("_pid", F.spark_partition_id()), "ranges")


def sessionize(df: DataFrame, key: str, ts: str, gap_seconds: int, bucket: str = "day") -> DataFrame:
    """Gap-based sessions per ``key``: ``(key, session_start, session_end, n)`` with
    ``session_end = last event + gap`` (the ``session_window`` convention).

    Skew-safe: events are ordered inside (key, time bucket) partitions only; the previous event
    of a bucket's first row comes from a per-bucket summary (one row per key and bucket), and the
    running session number across buckets is an offset over that summary. A key holding a third
    of all rows is therefore spread over its buckets instead of one task.
    """
    gap = gap_seconds * 1_000_000
    e = df.select(F.col(key).alias("k"), F.unix_micros(F.col(ts)).alias("t"),
                  F.date_trunc(bucket, F.col(ts)).alias("b"))
    # per-bucket summary and the last event time of the preceding non-empty bucket
    summ = e.groupBy("k", "b").agg(F.min("t").alias("b_first"), F.max("t").alias("b_last"))
    wk = Window.partitionBy("k").orderBy("b")
    summ = summ.withColumn("prev_last", F.lag("b_last").over(wk))
    # inside a bucket: previous event time; a new session starts when the gap is reached
    wb = Window.partitionBy("k", "b").orderBy("t")
    e = e.withColumn("prev_t", F.lag("t").over(wb))
    e = e.join(summ.select("k", "b", "prev_last"), ["k", "b"])
    prev = F.coalesce(F.col("prev_t"), F.col("prev_last"))
    e = e.withColumn("start", (prev.isNull() | (F.col("t") - prev >= gap)).cast("long"))
    # session number = starts in earlier buckets (offset over the summary) + starts so far here
    # among equal timestamps the (single) session start must come first
    ws = Window.partitionBy("k", "b").orderBy("t", F.col("start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("local_sid", F.sum("start").over(ws))
    starts = e.groupBy("k", "b").agg(F.sum("start").alias("n_starts"))
    off = starts.withColumn("off", F.coalesce(F.sum("n_starts").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0))).drop("n_starts")
    e = e.join(off, ["k", "b"]).withColumn("sid", F.col("off") + F.col("local_sid"))
    s = e.groupBy("k", "sid").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    return s.select(F.col("k").alias(key), F.timestamp_micros("t0").alias("session_start"),
                    F.timestamp_micros(F.col("t1") + gap).alias("session_end"), "n")
