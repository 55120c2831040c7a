"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only DataFrame functions; single numbers (totals, the water level of the targets) are all that reaches the
driver.

1. Sizes in words, then totals by (source, shard). A shard is a hash of the document, so the largest
   source is dealt over as many shards as its rows fill; a shard has about ``SHARD_ROWS`` rows.
2. Targets share all words by weight. A source whose target is above ``REPEATS`` times its size stops
   there; what is left over is shared again by weight among the others, until none is above.
3. The words are apportioned in blocks of ``BLOCK``: the blocks go to the highest quotients
   target / (2 * seats + 1), first among sources, then each source's blocks among its shards by size. All
   quotients need not be laid out: rounding target * blocks / total gives every party's seats but for
   a few, and only the quotients near that line are ranked (see ``apportion``).
4. A shard's documents stand end to end in a seeded order. Its quota takes everything as often as it fits,
   and the rest from blocks that a seeded permutation of the shard's blocks selects, the last of them in
   part, so that a shard's words are exactly its quota. A document has the words of it that lie in
   chosen blocks; none is taken more than ``REPEATS`` times.

Sources are weighed in code point order, a null source last; an empty source name is a source. Null texts
have no words. Documents with a null id are seeded by "null", rows with equal ids by their size too. A
repeated row is a document of its own. Empty tables give empty results, tables without words zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored
from corpuslens.operators.ranking import row_index

WEIGHTS, REPEATS = (5, 2, 1), 3
BLOCK = 32
SHARD_ROWS = 2048
SEED = "mix-1"
PRIME = 2147483647  # above any shard's number of blocks, so that its multiples permute them
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space: places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(*parts: Column) -> Column:
    """An MD5 digest that a seed and the parts fix."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary"))


def _number(digest: Column, first: int) -> Column:
    """Seven hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, first, 7), 16, 10).cast("long")


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``sources(size, weight)`` with their ``target`` and, as whole numbers in the same proportions, ``votes``.

    Each round lets the sources above their limit stop there and shares what they leave. Both numbers of a
    round, the words left and the weight left, are sums over all sources."""
    all_words, all_weight, _ = _sums(sources, F.lit(True))
    left, weight, stopped = all_words, max(all_weight, 1), 0
    while True:
        # the level left / weight only rises, so a source that has stopped stays above it
        above = F.col("weight").cast(BIG) * F.lit(left).cast(BIG) > F.col("size").cast(BIG) * repeats * F.lit(weight).cast(BIG)
        words, heavy, n = _sums(sources, above)
        if n == stopped:
            break
        left, weight, stopped = all_words - repeats * words, all_weight - heavy, n
    limit = F.col("size") * repeats
    return sources.withColumns({
        "target": F.when(above, limit.cast("double")).otherwise((F.col("weight") * left).cast("double") / F.lit(weight).cast("double")),
        "votes": F.when(above, limit.cast(BIG) * weight).otherwise(F.col("weight").cast(BIG) * F.lit(left).cast(BIG)).cast(BIG)})


def _sums(sources: DataFrame, which: Column) -> tuple[int, int, int]:
    """Words, weight and number of some sources."""
    s = sources.where(which).agg(F.sum("size").alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    return int(s.s or 0), int(s.w or 0), s.n


def apportion(parties: DataFrame, group: str, party: str) -> DataFrame:
    """Sainte-Laguë: ``parties(group, party, votes, seats_of_group)`` with ``seats``; ties of quotients go to
    the lower party.

    Rounding votes * seats / all votes gives a party the quotients above one common line. The sum misses the
    group's seats by d, at most half the number n of parties. Moving the line until d more or fewer
    quotients are above it moves a party's seats by at most its share of d + n, plus 1: only so many quotients
    on either side of its line are ranked, about 7 n in a group, by range partitions."""
    some = parties.where("votes > 0 and seats_of_group > 0")
    stats = some.groupBy(group).agg(F.sum("votes").cast(BIG).alias("_all"), F.count(F.lit(1)).alias("_n"))
    rounded = _back(some, stats, group).withColumn(
        "_line", F.expr("(2 * CAST(votes AS DECIMAL(25,0)) * seats_of_group + _all) div (2 * _all)").cast("long"))
    rounded = stored(rounded, "rounded")
    off = rounded.groupBy(group).agg(F.abs(F.max("seats_of_group") - F.sum("_line")).alias("_d"))
    near = _back(rounded, off, group).withColumn(
        "_m", F.ceil(F.col("votes").cast("double") / F.col("_all").cast("double") * (F.col("_d") + F.col("_n"))).cast("long") + 1)
    near = near.withColumn("_base", F.greatest(F.col("_line") - F.col("_m"), F.lit(0)))
    near = stored(near, "near")
    open_seats = near.groupBy(group).agg((F.max("seats_of_group") - F.sum("_base")).alias("_open"))
    quotients = near.select(group, party, F.explode(F.sequence(F.col("_base"), F.col("_line") + F.col("_m") - 1)).alias("_k"),
                            "votes").withColumn("_q", F.col("votes").cast("double") / (2 * F.col("_k") + 1))
    ranked = row_index(quotients.select(group, party, "_q"), [F.col(group), F.desc("_q"), F.col(party)], name="_rn")
    first = ranked.groupBy(group).agg(F.min("_rn").alias("_first"))
    top = _back(_back(ranked, first, group), open_seats, group).where("_rn - _first < _open")
    won = top.groupBy(group, party).agg(F.count(F.lit(1)).alias("_won"))
    seated = near.join(won, [group, party], "left").select(
        group, party, (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long").alias("seats"))
    return parties.join(seated, [group, party], "left").withColumn("seats", F.coalesce("seats", F.lit(0).cast("long")))


def _back(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Joins one row per key to many, a key's rows dealt over sub-keys."""
    salts = 32
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def _taken() -> Column:
    """Words taken of a document that stands at ``_at`` in its shard.

    ``_full`` rounds over everything, then ``_rest`` words: block i is taken if its place in the shard's seeded
    permutation is below ``_rest`` div BLOCK, and in part if it is equal. Words behind the last whole block
    come in last."""
    whole = F.expr(f"_size_u div {BLOCK}")
    picks, part = F.expr(f"_rest div {BLOCK}"), F.expr(f"_rest % {BLOCK}")
    end = F.col("_at") + F.col("size")

    def overlap(i: Column) -> Column:
        place = (i * PRIME + F.col("_shift")) % F.greatest(whole, F.lit(1))
        reach = (F.when(i >= whole, F.greatest(F.col("_rest") - whole * BLOCK, F.lit(0)))
                 .when(place < picks, F.lit(BLOCK)).when(place == picks, part).otherwise(F.lit(0)))
        return F.greatest(F.least(end, i * BLOCK + reach) - F.greatest(F.col("_at"), i * BLOCK), F.lit(0).cast("long"))

    blocks = F.sequence(F.expr(f"_at div {BLOCK}"), F.expr(f"(_at + size - 1) div {BLOCK}"))
    extra = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, i: (acc + overlap(i)).cast("long"))
    return F.when(F.col("size") > 0, F.col("_full") * F.col("size") + F.when(F.col("_rest") > 0, extra).otherwise(F.lit(0))
                  ).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: id, ``source, size, source_size, target, shard, quota`` (blocks of the shard) and
    ``taken``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
                       n_words(F.col(text)).alias("size"))
    digest = _seeded(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    name = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))
    rows = stored(rows.withColumn("digest", digest).withColumn("name", name)
                  .withColumn("shard", F.pmod(_number(F.col("digest"), 1), F.lit(shards))), "sizes")

    units = stored(rows.groupBy("name", "shard").agg(F.sum("size").alias("votes")), "units")
    sources = units.groupBy("name").agg(F.sum("votes").alias("size"))
    sources = row_index(sources, ["name"], name="_rank")
    kinds = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = stored(sources.withColumn("weight", F.element_at(kinds, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)),
                     "sources")
    aimed = stored(targets(sources, repeats), "targets")
    total = int(sources.agg(F.sum("size").alias("t")).first().t or 0)
    blocks = (2 * total + BLOCK) // (2 * BLOCK)
    aimed = aimed.withColumns({"all": F.lit(0), "seats_of_group": F.lit(blocks).cast("long")})
    seated = stored(apportion(aimed, "all", "name"), "seats")
    parts = _back(units, seated.select("name", F.col("seats").alias("seats_of_group"), F.col("size").alias("source_size"),
                                       "target"), "name")
    quotas = stored(apportion(parts, "name", "shard"), "quotas")
    words = F.least(F.col("seats") * BLOCK, F.col("votes") * repeats)
    full = F.when(F.col("votes") > 0, F.expr(f"least(seats * {BLOCK}, votes * {repeats}) div votes")).otherwise(F.lit(0))
    quotas = quotas.select("name", "shard", "source_size", "target", F.col("seats").alias("quota"),
                           F.col("votes").alias("_size_u"), full.cast("long").alias("_full"),
                           (words - full * F.col("votes")).cast("long").alias("_rest"))
    order = Window.partitionBy("name", "shard").orderBy("digest", "id", "size")
    placed = rows.withColumn("_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(quotas, ["name", "shard"])
    shift = _number(_seeded(F.col("name"), F.col("shard").cast("string")), 8)
    taken = placed.withColumn("_shift", shift).withColumn("taken", _taken())
    return taken.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "shard", "quota", "taken")
