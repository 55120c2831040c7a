"""Ordered ingest of paged results that land in any order.

A collector asks for page after page of a chain (one query): a page answers a ``cursor`` and names the next
one, the first answers an empty cursor. The landed pages may come in any order, more than once, or not at
all. Posts are emitted once, in the order of their chain, as far as its pages are there without a gap; what
lies behind a gap waits for the missing page.

Each micro-batch joins the waiting pages with the new ones and finds every page's distance to the head of its
run of linked pages by pointer doubling, in as many rounds as the logarithm of the longest run; runs whose
head is the cursor that the chain waits for are emitted. What is known after a micro-batch is written to
folders of its own, so a replayed micro-batch replaces its earlier attempt and a restarted job goes on.

Two answers to one cursor in a micro-batch are a fork: the one with the smaller next cursor is followed.
Answers to a cursor whose page was emitted change nothing. Pages linked in a circle have no head and wait.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import ensure_checkpoint_dir
from corpuslens.sources.schemas import API_PAGE
from corpuslens.sources.sinks import written

PAGE = T.StructType([T.StructField("chain", T.StringType()), T.StructField("cursor", T.StringType()), *API_PAGE.fields])


def link_runs(pages: DataFrame) -> DataFrame:
    """``pages(chain, cursor, next_cursor)``, one row per cursor, with ``head``, the first cursor of the run of pages
    that leads here, and ``steps``, the pages between; pages in a circle have a null head.

    If several pages name the same next cursor, the run goes through the one with the smallest cursor."""
    before = (pages.where("next_cursor is not null").groupBy("chain", F.col("next_cursor").alias("cursor"))
              .agg(F.min("cursor").alias("_before")))
    state = pages.select("chain", "cursor").join(before, ["chain", "cursor"], "left").select(
        "chain", "cursor", F.coalesce("_before", "cursor").alias("head"),
        F.when(F.col("_before").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    state = written(state, "links")
    longest, reach = pages.count(), 1
    while True:
        up = state.select("chain", F.col("cursor").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        state = written(state.join(up, ["chain", "head"]).select(
            "chain", "cursor", F.col("_head").alias("head"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("_steps") > 0).alias("_moved")), "links")
        reach *= 2
        if reach > 2 * longest or state.where("_moved").isEmpty():
            break
    circle = F.col("_moved") if reach > 2 * longest else F.lit(False)  # no run is longer than there are pages
    return state.select("chain", "cursor", F.when(~circle, F.col("head")).alias("head"), "steps")


class PageFeed:
    """Pages landed and posts emitted in a folder, a subfolder per micro-batch in each of its tables."""

    POSTS = T.StructType([T.StructField("chain", T.StringType()), T.StructField("page_rank", T.LongType()),
                          T.StructField("pos", T.IntegerType()), T.StructField("post", API_PAGE["tweets"].dataType.elementType)])
    FRONT = T.StructType([T.StructField("chain", T.StringType()), T.StructField("awaits", T.StringType()),
                          T.StructField("emitted", T.LongType())])
    DONE = T.StructType([T.StructField("chain", T.StringType()), T.StructField("cursor", T.StringType())])

    def __init__(self, spark: SparkSession, path: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str, batch: int, schema: T.StructType) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/batch={batch}")

    def _all(self, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        if before == 0:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.path}/{table}")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _put(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def append(self, landed: DataFrame, batch: int) -> None:
        """Take a micro-batch of pages; batches are numbered from 0 without gaps, and adding the last one again gives the
        same result."""
        self._put(landed.select(*PAGE.names), "landed", batch)
        new = self._at("landed", batch, PAGE)
        front = self._at("front", batch - 1, self.FRONT)
        waiting = self._at("waiting", batch - 1, PAGE)
        open_pages = waiting.unionByName(new).where("chain is not null and cursor is not null").join(
            self._all("emitted", self.DONE, batch), ["chain", "cursor"], "left_anti")
        last = ~F.coalesce("has_next_page", F.lit(False)) | F.col("next_cursor").isNull()
        follow = F.when(~last, F.col("next_cursor"))
        chosen = open_pages.groupBy("chain", "cursor").agg(F.min_by(F.struct(
            "tweets", F.lit(True).alias("has_next_page"), follow.alias("next_cursor")),
            F.struct(follow.isNull(), follow, F.coalesce(F.size("tweets"), F.lit(0)).alias("size"))).alias("p"))
        pages = written(chosen.select("chain", "cursor", F.col("p.tweets").alias("tweets"), F.col("p.next_cursor").alias("next_cursor")), "pages")
        runs = written(link_runs(pages.select("chain", "cursor", "next_cursor")), "runs")
        fronts = (pages.select("chain").distinct().join(front, "chain", "left")
                  .select("chain", F.when(F.col("emitted").isNull(), F.lit("")).otherwise(F.col("awaits")).alias("awaits"),
                          F.coalesce("emitted", F.lit(0)).alias("emitted")))
        ready = runs.join(fronts, "chain").where("head = awaits").select(
            "chain", "cursor", (F.col("emitted") + F.col("steps")).alias("page_rank"))
        ready = written(ready, "ready")
        out = pages.join(ready, ["chain", "cursor"])
        self._put(out.select("chain", "page_rank", F.posexplode(F.coalesce("tweets", F.array())).alias("pos", "post")), "posts", batch)
        self._put(ready.select("chain", "cursor"), "emitted", batch)
        ahead = out.groupBy("chain").agg(F.max_by(F.struct("next_cursor"), "page_rank").alias("n"),
                                         (F.max("page_rank") + 1).alias("emitted"))
        moved = ahead.select("chain", F.col("n.next_cursor").alias("awaits"), "emitted")
        self._put(front.join(moved, "chain", "left_anti").unionByName(moved), "front", batch)
        rest = open_pages.join(ready, ["chain", "cursor"], "left_anti").select(*PAGE.names)
        self._put(rest, "waiting", batch)

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """Take everything a page stream has; call again with the same checkpoint to go on."""
        query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda rows, epoch: self.append(rows, epoch)).start())
        query.awaitTermination()

    def posts(self) -> DataFrame:
        """``chain, page_rank`` (from 0), ``pos`` (in the page) and the post's columns."""
        return self._all("posts", self.POSTS).select("chain", "page_rank", "pos", "post.*")

    def report(self) -> DataFrame:
        """Per chain: ``landed`` pages, ``repeats`` (equal answers to a cursor beyond the first), ``forks`` (cursors with
        different answers), ``gaps`` (cursors that some page names next and no page answers), ``emitted`` pages and
        ``waiting`` cursors."""
        landed = self._all("landed", PAGE).where("chain is not null and cursor is not null")
        follow = F.when(F.coalesce("has_next_page", F.lit(False)), F.col("next_cursor"))
        answers = landed.groupBy("chain", "cursor", follow.alias("follow")).agg(F.count(F.lit(1)).alias("n"))
        cursors = answers.groupBy("chain", "cursor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        named = answers.where("follow is not null").select("chain", F.col("follow").alias("cursor")).distinct()
        gaps = named.join(cursors, ["chain", "cursor"], "left_anti").groupBy("chain").agg(F.count(F.lit(1)).alias("gaps"))
        done = self._all("emitted", self.DONE).groupBy("chain").agg(F.count(F.lit(1)).alias("emitted"))
        total = cursors.groupBy("chain").agg(F.sum("n").alias("landed"), F.sum(F.col("n") - F.col("k")).alias("repeats"),
                                             F.count_if(F.col("k") > 1).alias("forks"), F.count(F.lit(1)).alias("_cursors"))
        out = total.join(gaps, "chain", "left").join(done, "chain", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        return out.select("chain", "landed", "repeats", "forks", zero("gaps").alias("gaps"), zero("emitted").alias("emitted"),
                          (F.col("_cursors") - zero("emitted")).alias("waiting"))
