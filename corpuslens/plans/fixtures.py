"""Derived fixture views over the driver tables (see FIXTURES.md §C).

Each view is a plain DataFrame expression over whole tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.keywords import BASE_LANG, INSTITUTIONS, TOPIC_GROUPS, exclusion_phrases, or_terms
from corpuslens.sources.tables import table

# Lexicon of the labelled fixture (whole-token matches mark toxic documents).
FIXTURE_NEGATIVE_LEXICON = "stupid scum pathetic moron trash idiot clown loser disgusting worthless".split()
NEGATIVE_TERMS = or_terms(dict(TOPIC_GROUPS)["guclu_negatif"]) + FIXTURE_NEGATIVE_LEXICON
POSITIVE_TERMS = or_terms(dict(TOPIC_GROUPS)["guclu_pozitif"])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def posts_fx(spark: SparkSession, sf: str) -> DataFrame:
    """Post table (A1 schema subset) with mentions, tags, URLs and numbers appended."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rfc = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "),
                   F.year("ts").cast("string"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    text = F.concat(F.col("text"), F.lit(" @"), F.col("source"), F.lit(" #"), F.col("lang"),
                    F.lit(" http://t.example/"), F.col("doc_id").cast("string"),
                    F.lit("?q=1 www.x.example "), F.col("n_chars").cast("string"), F.lit(",5"))
    return (d.join(e, d.doc_id == e.event_id)
            .select(F.col("doc_id").alias("seq"),
                    F.col("doc_id").cast("string").alias("id"),
                    F.col("source").alias("university"),
                    F.col("lang").alias("group"),
                    text.alias("text"),
                    F.when(F.col("doc_id") % 2 == 0, rfc).otherwise(iso).alias("createdAt"),
                    F.col("ts")))


def labeled_fx(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return (d.join(lab, "doc_id")
            .select("doc_id", "text", "source", F.col("toxic").alias("label"),
                    F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("is_synth")))


def label3_fx(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return (d.join(lab, "doc_id")
            .select("doc_id", "text", F.col("source").alias("universite"),
                    F.when(F.col("quality") == 0, 9).otherwise(F.col("toxic")).alias("label")))


def scores_fx(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    e0 = F.col("embedding")[0].cast("double")
    return e.select("vec_id", (F.col("label") % 2).alias("y"),
                    F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("is_synth"),
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * e0))).alias("prob_pos"))


def logits3_fx(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    z = F.array(*[(F.lit(4.0) * F.col("embedding")[i].cast("double")) for i in range(3)])
    return e.select("vec_id", (F.col("label") % 3).alias("y"), z.alias("logits"))


def sentiment_fx(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    tags = (F.when(F.col("event_type") == "error", 0)
            .when(F.col("event_type") == "purchase", 1).otherwise(9))
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("u"), (F.col("user_id") % 14).cast("string")).alias("university"),
                     tags.alias("tags"), "value")


def metric_log_fx(spark: SparkSession, sf: str) -> DataFrame:
    """Heterogeneous trainer log: 'view' rows are train records, 'click' rows evaluation records."""
    ev = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    epoch = (F.unix_timestamp(F.col("ts").cast("timestamp")) / F.lit(86400.0))
    train = F.to_json(F.struct(epoch.alias("epoch"), F.col("value").alias("loss")))
    evalr = F.when(F.col("event_id") % 2 == 0,
                   F.to_json(F.struct(epoch.alias("epoch"), F.col("value").alias("eval_loss"),
                                      (F.col("value") / 50.0).alias("eval_macro_f1")))) \
        .otherwise(F.to_json(F.struct(epoch.alias("epoch"), F.col("value").alias("eval_loss"))))
    return ev.select("event_id", "user_id",
                     F.when(F.col("event_type") == "view", train).otherwise(evalr).alias("record"))


def pages_fx(spark: SparkSession, sf: str) -> DataFrame:
    """API pages of at most 20 posts: a conversation's turns in turn order (nested A2 schema).

    Page size is bounded like a real paged API, so no group grows with the data."""
    c = table(spark, sf, "conversations")
    author = F.struct(F.when(F.col("turn") % 3 == 2, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lit(" loc"), (F.col("conv_id") % 7).cast("string"), F.lit(" ")))
                      .alias("location"),
                      F.col("role").alias("userName"))
    tweet = F.struct(F.lit("tweet").alias("type"),
                     (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"),
                     F.concat(F.lit("https://x.example/"), F.col("conv_id").cast("string"), F.lit("/"),
                              F.col("turn").cast("string")).alias("url"),
                     F.col("text").alias("text"),
                     F.lit("2024-01-15T12:00:00Z").alias("createdAt"),
                     F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(author).alias("author"))
    return (c.groupBy("conv_id", F.floor(F.col("turn") / 20).alias("page_no"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), tweet.alias("tw")))).alias("t"))
            .select("conv_id", "page_no", F.transform("t", lambda x: x["tw"]).alias("tweets"),
                    (F.col("conv_id") % 2 == 0).alias("has_next_page"),
                    F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("next_cursor")))


ALIASES = [t for _, expr in INSTITUTIONS for t in or_terms(expr)]
TOPIC_TERMS = [t for _, expr in TOPIC_GROUPS for t in or_terms(expr)]
EXCLUDED = exclusion_phrases()


def catalog_fx(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with catalogue phrases appended so that each part of the composed predicate holds for some and
    fails for others; every tenth text consists of its phrases alone, so that texts repeat. ``batch`` says in which
    of three landings a post arrives."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    i = F.col("doc_id")

    def term(terms: list[str], at, there):
        return F.when(there, F.concat(F.lit(" | "), F.element_at(F.array(*[F.lit(t) for t in terms]),
                                                                 (F.pmod(at, F.lit(len(terms))) + 1).cast("int")))).otherwise("")

    phrases = F.concat(term(ALIASES, i, i % 4 != 3), term(TOPIC_TERMS, F.floor(i / 2), i % 5 != 4),
                       term(ALIASES, i * 7 + 3, i % 6 == 0), term(EXCLUDED, F.floor(i / 11), i % 11 == 0))
    return d.select("doc_id", F.concat(F.when(i % 10 == 7, F.lit("")).otherwise(F.coalesce("text", F.lit(""))), phrases).alias("text"),
                    F.when(i % 3 != 1, F.lit(BASE_LANG)).otherwise(F.col("lang")).alias("lang"),
                    ((i * 13 % 7) % 3).cast("long").alias("batch"))


def landed_pages_fx(spark: SparkSession, sf: str) -> DataFrame:
    """Two-post pages of conversations as a collector lands them, with the cursor each answers: some never land, some
    land twice, and some cursors also get an empty last page as a second answer. ``landing`` says when."""
    c = table(spark, sf, "conversations")
    post = F.struct(F.lit("tweet").alias("type"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"),
                    F.col("text"))
    p = (c.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("p"))
         .agg(F.sort_array(F.collect_list(F.struct("turn", post.alias("post")))).alias("t")))
    last = c.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("last"))
    p = p.join(last, "conv_id").where((F.col("conv_id") * 7 + F.col("p") * 3) % 23 != 5)
    cursor = lambda at: F.when(at == 0, F.lit("")).otherwise(F.concat_ws("-", F.col("conv_id").cast("string"), at.cast("string")))
    lot = F.pmod(F.xxhash64("conv_id", "p"), F.lit(3))
    more = F.col("p") < F.col("last")
    page = p.select("conv_id", "p", F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("chain"), cursor(F.col("p")).alias("cursor"),
                    F.transform("t", lambda x: x["post"]).alias("tweets"), more.alias("has_next_page"),
                    F.when(more, cursor(F.col("p") + 1)).alias("next_cursor"), lot.alias("landing"))
    again = page.where((F.col("conv_id") + F.col("p")) % 6 == 0).withColumn("landing", F.pmod(F.col("landing") + 1, F.lit(3)))
    fork = page.where(F.col("has_next_page") & ((F.col("conv_id") * 5 + F.col("p")) % 19 == 7)).withColumns(
        {"tweets": F.slice("tweets", 1, 0), "has_next_page": F.lit(False), "next_cursor": F.lit(None).cast("string")})
    # the two answers of a fork land in one file
    return page.unionByName(again).unionByName(fork).repartition(24, "conv_id", "p", "landing").drop("conv_id", "p")
