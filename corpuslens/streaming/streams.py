"""Structured Streaming: incremental file ingest with resume, streaming dedupe, windowed volume.

Every query uses a checkpoint folder under ``spark.checkpoint.dir`` (shared storage), so a
restarted job resumes from the last committed offsets and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.sources.sinks import scratch_path
from corpuslens.streaming.pages import link_runs

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                fmt: str = "parquet", max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """File stream over a landing folder (new files are picked up incrementally)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``withWatermark`` needs a TIMESTAMP (not TIMESTAMP_NTZ) column."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _timed(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return with_event_time(df, ts, delay) if delay else df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain everything available (``availableNow``) into a parquet table under the checkpoint
    folder via ``foreachBatch`` and return it as a batch DataFrame.

    Each micro-batch overwrites its own ``batch_id=<epoch>`` folder, so a retried batch replaces
    its earlier attempt instead of appending twice (idempotent sink). In ``complete`` mode only the
    latest epoch holds the current result. Give ``out`` and ``checkpoint`` to go on where an earlier call
    with the same folders ended.
    """
    out = out or scratch_path(spark, f"stream-{name}")
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}-ckpt")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={epoch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if mode == "complete":
        last = res.agg(F.max("batch_id")).first()[0]  # one scalar
        res = res.where(F.col("batch_id") == last)
    return res.drop("batch_id")


def stream_dedupe(stream: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str = "ts", size: str = "1 day", label: str = "event_type",
             positive: str = "purchase", negative: str = "error", delay: str | None = None) -> DataFrame:
    """Counts per window. With ``delay`` a watermark closes windows, so that append mode emits each
    once and state is bounded by the open windows; without it only complete mode will do."""
    w = F.window(ts, size)
    return (_timed(stream, ts, delay)
            .groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.col(label) == positive).alias("n_pos"),
                                       F.count_if(F.col(label) == negative).alias("n_neg")))


def sliding(stream: DataFrame, ts: str = "ts", size: str = "7 days", slide: str = "1 day",
            delay: str | None = None) -> DataFrame:
    """Overlapping windows; ``delay`` as in ``tumbling``."""
    w = F.window(ts, size, slide)
    return (_timed(stream, ts, delay)
            .groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


def sessions(stream: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "1 hour",
             delay: str = "1 day") -> DataFrame:
    """Sessions of a key: rows at most ``gap`` apart. A session is emitted once, when the watermark
    passes its end (last row plus ``gap``); state holds the open sessions only. One key's state is held by one
    task; ``session_slices`` deals it by time."""
    return (with_event_time(stream, ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n")))


def session_slices(stream: DataFrame, key: str = "user_id", ts: str = "ts", gap_seconds: int = 3600,
                   slice_seconds: int = 6 * 3600, delay: str = "1 day") -> DataFrame:
    """Parts of sessions, ``key, slice, first, last`` (microseconds) and ``n``: sessions cut at the borders of time
    slices. State is kept by (key, slice), so that a key with a third of all rows is held by as many tasks as it
    has slices in the watermark's delay; ``join_slices`` makes whole sessions of the parts."""
    if gap_seconds > slice_seconds:
        raise ValueError("a slice must be as long as the gap at least")
    at = F.unix_micros(F.col(ts))
    timed = with_event_time(stream, ts, delay).withColumn("_slice", F.floor(at / F.lit(slice_seconds * 1_000_000)).cast("long"))
    part = timed.groupBy(key, "_slice", F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return part.select(F.col(key).alias("key"), F.col("_slice").alias("slice"), "first", "last", "n")


def join_slices(parts: DataFrame, watermark: int, gap_seconds: int = 3600, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Whole sessions, ``key, first, last, n``, of the parts that ``session_slices`` has emitted up to a watermark, in
    microseconds. A session whose end is so near a border that a part still open might go on with it waits.

    Parts that touch across a border are linked by an equality join on (key, slice); pointer doubling over the links
    finds the parts of a session, so no task sorts a key's sessions."""
    gap, size = gap_seconds * 1_000_000, slice_seconds * 1_000_000
    name = F.concat_ws(":", F.col("slice").cast("string"), F.col("first").cast("string"))
    p = parts.select(F.col("key").cast("string").alias("chain"), "key", name.alias("cursor"), "slice", "first", "last", "n")
    onward = p.where(F.col("last") + gap >= (F.col("slice") + 1) * size)
    after = p.select("chain", (F.col("slice") - 1).alias("slice"), F.col("first").alias("_first"), F.col("cursor").alias("next_cursor"))
    links = onward.join(after, ["chain", "slice"]).where(F.col("_first") - F.col("last") <= gap).select("chain", "cursor", "next_cursor")
    ends = links.select("chain", F.col("next_cursor").alias("cursor"))
    touched = links.select("chain", "cursor").unionByName(ends).distinct().join(links, ["chain", "cursor"], "left")
    runs = link_runs(touched).select("chain", "cursor", "head")
    whole = (p.join(runs, ["chain", "cursor"], "left").withColumn("head", F.coalesce("head", "cursor"))
             .groupBy("key", "head").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
                                         F.max("slice").alias("slice")))
    border = (F.col("slice") + 1) * size
    closed = F.when(F.col("last") + gap < border, F.col("last") + gap <= watermark).otherwise(border + size + gap <= watermark)
    return whole.where(closed).select("key", "first", "last", "n")
