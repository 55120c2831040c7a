"""Attribution of posts to one query, kept over appended batches.

A text that several queries find, or that arrives several times, belongs to the query of the lowest rank in the
earliest batch that has it. The winner is a minimum of ``(batch, rank, seq)`` per text, so partial results
merge in any order, and a later batch can never change what an earlier one has decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ensure_checkpoint_dir

STATE = "key binary, rank int, seq long"


def text_key(text: str):
    return F.unhex(F.sha2(F.col(text), 256))


def first_per_text(hits: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``key`` (digest of the text) and the ``order`` columns of the least row of each text; null texts are left out.
    Only digests and the order columns are shuffled, and a frequent text's rows are reduced where they are read."""
    rows = hits.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.struct(*order).alias("o"))
    return rows.groupBy("key").agg(F.min("o").alias("o")).select("key", "o.*")


class AttributionTable:
    """Attributed texts in a folder, one subfolder per batch. Writing a batch again replaces it, so a batch that is
    replayed after a failure leaves no repeats."""

    def __init__(self, spark: SparkSession, path: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """``key, rank, seq, batch`` of all texts."""
        return self.spark.read.schema(STATE + ", batch long").parquet(self.path)

    def append(self, hits: DataFrame, batch: int) -> None:
        """Add a batch of ``hits(rank, seq, text)``; texts of earlier batches keep what they have. Batches are added in
        order; adding one again gives the same result only while no later one was added."""
        new = first_per_text(hits, "text", ["rank", "seq"])
        if batch and self._exists():
            new = new.join(self.read().where(F.col("batch") < batch).select("key"), "key", "left_anti")
        new.select(F.col("key"), F.col("rank").cast("int"), F.col("seq").cast("long")).write.mode("overwrite").parquet(
            f"{self.path}/batch={batch}")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stream(self, hits: DataFrame, checkpoint: str):
        """A query that appends each micro-batch of a streaming ``hits(rank, seq, text)``."""
        return (hits.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                .foreachBatch(lambda rows, epoch: self.append(rows, epoch)).start())
