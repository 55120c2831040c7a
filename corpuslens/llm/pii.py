"""Personal data: fixed patterns, and bootstrapped contextual extraction of further identifiers.

Only DataFrame functions. Four kinds come from patterns: e-mail, IPv4 address, payment card (13 to 19
digits that pass Luhn) and international phone number (9 to 15 digits). They are the seeds.

Bootstrapping: an instance is a token with a digit or an at sign, a lexical pattern is the word
before it. Spark counts the pattern-instance graph over all texts and scores both sides in rounds. A pattern's
confidence is the score of the instances it stands before, over all its occurrences in the
corpus; so a word that often stands elsewhere is no pattern. An instance's score is 1 if it is (part of) a
seed, else the largest confidence of its trusted patterns. A pattern is trusted if its confidence is at least
``trust`` and it stands before at least ``support`` different instances with a score, seeds or learned; so
learned instances support further patterns. The rounds go on to the fixed point: no pattern is added and no
confidence grows. Then tokens behind a trusted pattern that no seed covers are added as kind ``context``.

Positions are code points, ends exclusive. Null texts are empty. A row is known by its id and text,
so repeated rows get the same result, and rows with null ids their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "context")
# Each pattern finds the contract's leftmost matches. Possessive repeats and the look-behinds (a match
# starts at a run's beginning or where the last match ended) keep the search linear in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
SPACE = r"[\x20\x09-\x0D]+"
# The last word of a text that blanks follow; the look-behind and possessive repeats keep it linear.
LAST_WORD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\z"

TRUST, SUPPORT = 0.8, 5
STILL = 1e-9  # confidences that grow by less in a round, all together, are at their fixed point


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid() -> Column:
    """Does a match of kind ``kind`` pass its test?"""
    byte = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    digits = F.regexp_replace("hit", "[^0-9]", "")
    card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return (F.when(F.col("kind") == 1, F.col("hit").rlike(rf"^{byte}(\.{byte}){{3}}$"))
            .when(F.col("kind") == 2, card)
            .when(F.col("kind") == 3, F.length(digits).between(9, 15)).otherwise(True))


def _found(text: Column, kind: int, pattern: str, may: Column) -> Column:
    """Array of ``kind, i, gap, hit, left``: every match, the length of the text before it since the last
    match, and for tokens the last word of that text. Only texts that ``may`` hold a match are searched."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    made = F.transform(pairs, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(z["gap"]).alias("gap"), z["hit"].alias("hit"),
        (F.lower(F.regexp_extract(z["gap"], LAST_WORD, 1)) if pattern == TOKEN else F.lit("")).alias("left")))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string,left:string>>")
    return F.when(may, made).otherwise(empty)


def matches(docs: DataFrame) -> DataFrame:
    """``key, kind, start, end, hit, left`` of all pattern matches and instance tokens of ``docs(key, text)``."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    every = F.concat(
        _found(text, 0, EMAIL, F.contains(text, F.lit("@"))), _found(text, 1, IP, text.rlike(r"[0-9]\.[0-9]")),
        _found(text, 2, CARD, digit), _found(text, 3, PHONE, F.contains(text, F.lit("+"))),
        _found(text, 4, TOKEN, digit | F.contains(text, F.lit("@"))))
    rows = docs.select("key", F.explode_outer(every).alias("m")).select("key", "m.*").where("hit is not null")
    rows = stored(rows, "matches").dropDuplicates(["key", "kind", "i"])
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.char_length("hit")).over(before)
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("hit"))
            .where(_valid()).select("key", "kind", "start", "end", "hit", "left"))


def _instances(found: DataFrame) -> DataFrame:
    """Instance tokens with ``seed``: does a base match begin or go on in the token?"""
    token = F.col("kind") == 4
    at = F.when(token, F.col("end") - 1).otherwise(F.col("start"))
    so_far = Window.partitionBy("key").orderBy("_at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~token, F.col("end"))).over(so_far)
    return (found.withColumn("_at", at).withColumn("_reach", reach).where(token)
            .select("key", "start", "end", "left", F.lower("hit").alias("instance"),
                    F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)).alias("seed")))


def bootstrap(instances: DataFrame, texts: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """``pattern, confidence`` of the trusted patterns. ``texts`` has ``text``: the corpus for word totals.

    Only patterns that could be trusted if every instance had score 1 stay in the graph. Scores only grow
    from round to round, so the rounds end.
    """
    graph = stored(instances.where("left <> ''").groupBy(F.col("left").alias("pattern"), "instance")
                   .agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "graph")
    seeds = graph.groupBy("instance").agg(F.max("seed").alias("seed"))
    likely = (graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("most"))
              .where(F.col("support") >= support).select("pattern", "most"))
    words = texts.select(F.explode(F.split(F.lower("text"), SPACE)).alias("pattern")).where("pattern <> ''")
    totals = (words.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).join(likely, "pattern")
              .where(F.col("most") >= F.col("total") * F.lit(trust - STILL)).select("pattern", "total"))
    edges = stored(graph.drop("seed").join(stored(totals, "totals"), "pattern").join(seeds, "instance"), "edges")
    score = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = edges.withColumn("score", score)
    before = (0, 0.0)
    while True:
        good = (scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("confidence"),
                                              F.count_if(F.col("score") > 0).alias("support"))
                .where((F.col("confidence") >= trust) & (F.col("support") >= support)).select("pattern", "confidence"))
        good = stored(good, "patterns")
        now = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if now[0] == before[0] and now[1] - before[1] < STILL:
            return good
        before = now
        learned = (edges.join(good, "pattern").groupBy("instance").agg(F.max("confidence").alias("learned")))
        scored = edges.join(learned, "instance", "left").withColumn(
            "score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("learned", F.lit(0.0))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", trust: float = TRUST,
                  support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id and ``found``, an array of ``kind, start, end`` by kind, then start;
    kinds are places in ``KINDS``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), body).alias("key"), body.alias("text"))
    found = stored(matches(source.select("key", "text")), "found")
    instances = stored(_instances(found), "instances")
    good = bootstrap(instances, source.select("text"), trust, support)
    more = (instances.where("not seed").join(good, instances["left"] == good["pattern"])
            .select("key", F.lit(4).alias("kind"), "start", "end"))
    spans = found.where("kind < 4").select("key", "kind", "start", "end").unionByName(more)
    grouped = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return source.select("id", "key").join(grouped, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def _written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    got = personal_data(docs)

    def number(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("found", lambda s: s["kind"] < 4)
    return got.select("doc_id", *[number(k) for k in range(4)],
                      F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))
