"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. Rows whose length occurs once have no prefix hash counted, rows whose
(length, prefix hash) occurs once are not compared by their full hash. The level tables hold one row per
surviving group, never per row. They are counted: up to ``SMALL_KEYS`` are broadcast, and then only the rows that
survive a level have their text read by the next. No text is shuffled at any level: where a level table
is larger, the keys of every row are computed where the table is read, and the join carries these alone.
Group results reach the rows through a salted join, so a text that makes up a third of the table is
dealt over many tasks.

Texts are equal when they are identical after lower-casing A-Z. A null text counts as empty. Of
equal texts the row with the largest id stays; rows with a null id lose against any other, and a
group that has only null ids keeps all of them. Rows repeated with the same id share their fate in
``exact_groups``; ``exact_dedup`` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, join_back, stored, with_group_stats

PREFIX_CHARS = 256
SMALL_KEYS = 1_000_000  # up to so many surviving keys are broadcast, more are joined by shuffle


def _normalised(text: str):
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def _small(table: DataFrame) -> DataFrame | None:
    """The table marked for broadcast, or None if it is too large."""
    return F.broadcast(table) if table.count() <= SMALL_KEYS else None


def _levels(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows with their two cheap keys, the key pairs that more than one row has, and whether these are few."""
    whole = F.coalesce(F.col(text), F.lit(""))
    prefix = F.xxhash64(ascii_lower(F.substring(whole, 1, PREFIX_CHARS)))
    keyed = docs.withColumn("_len", F.char_length(whole))
    lengths = stored(keyed.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len"), "lengths")
    few = _small(lengths)
    # with many lengths every pair is counted: one that repeats has a length that does
    rows = keyed.join(few, "_len", "left_semi") if few is not None else keyed
    pairs = rows.select("_len", prefix.alias("_pfx")).groupBy("_len", "_pfx").agg(F.count(F.lit(1)).alias("_n"))
    alike = stored(pairs.where("_n > 1").select("_len", "_pfx"), "alike")
    few = _small(alike)
    return keyed.withColumn("_pfx", prefix), alike if few is None else few, few is not None


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", all_digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``text_sha256`` is null for rows that an earlier level has shown to be unique. With
    ``all_digests`` it is given for every row, computed where the table is read, so that no text is
    shuffled; which rows are compared by it stays the same. So it is, for want of a broadcast, where more than
    ``SMALL_KEYS`` pairs of keys repeat.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    keyed, alike, few = _levels(docs, "_text")
    digest = F.sha2(_normalised("_text"), 256)
    early = all_digests or not few  # no text goes into a join by shuffle
    if early:
        keyed = keyed.withColumn("_sha", digest).drop("_text")
    marked = keyed.join(alike.withColumn("_alike", F.lit(True)), ["_len", "_pfx"], "left")
    if not early:
        marked = marked.withColumn("_sha", F.when(F.col("_alike"), digest)).drop("_text")
    elif not all_digests:
        marked = marked.withColumn("_sha", F.when(F.col("_alike"), F.col("_sha")))
    marked = marked.select("_id", "_sha", "_alike")
    grouped = with_group_stats(marked.where("_alike"), ["_sha"],
                               {"keep_id": ("max", "_id"), "group_size": ("count", "_sha")}, F.xxhash64("_id"))
    single = marked.where("_alike is null").select("_id", "_sha", F.col("_id").alias("keep_id"),
                                                   F.lit(1).cast("long").alias("group_size"))
    return (grouped.select("_id", "_sha", "keep_id", "group_size").unionByName(single)
            .select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one row for each distinct text.

    Rows that are unique by length or prefix pass untouched; the full hash is computed only for the
    others.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)  # columns of any name cannot clash with the keys below
    ident, body = names[docs.columns.index(id_col)], names[docs.columns.index(text)]
    keyed, alike, few = _levels(rows, body)
    if few:
        unique = keyed.join(alike, ["_len", "_pfx"], "left_anti").select(*names)
        hashed = keyed.join(alike, ["_len", "_pfx"], "left_semi").withColumn("_sha", F.sha2(_normalised(body), 256))
    else:
        unique, hashed = None, keyed.withColumn("_sha", F.sha2(_normalised(body), 256))
    # digests and ids alone decide who stays
    ids = stored(hashed.groupBy("_sha", F.col(ident).alias("_id")).agg(F.count(F.lit(1)).alias("_m")), "digests")
    keep = ids.groupBy("_sha").agg(F.max("_id").alias("_keep"))
    winners = join_back(ids, keep, ["_sha"], F.xxhash64("_id")).where(F.col("_id").eqNullSafe(F.col("_keep")))
    winners = stored(winners.select(F.col("_sha").alias("_won"), "_id", "_m"), "winners")
    few_winners = _small(winners)
    on = (F.col("_sha") == F.col("_won")) & F.col(ident).eqNullSafe(F.col("_id"))
    stays = hashed.join(winners if few_winners is None else few_winners, on)
    if not winners.where("_m > 1").isEmpty():  # rows repeated with the winner's id
        once = stays.where("_m = 1").select(*names)
        stays = once.unionByName(stays.where("_m > 1").dropDuplicates(["_sha"]).select(*names))
    stays = stays.select(*names)
    return (stays if unique is None else unique.unionByName(stays)).toDF(*docs.columns)
