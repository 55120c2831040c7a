"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Only DataFrame functions. A document leaks an item when one of its windows of as many words as the
item (the whole document, if it is shorter) has a weighted-shingle similarity of ``percent`` or more
with it: the sum of the smaller over the sum of the larger counts of all five-word shingles.

1. Windows are laid where a match can be. A matching window holds at least
   ceil(percent * S) of the item's S shingles, so the document's shingles are looked up among those of
   the benchmark, and only windows that hold enough of them go on. This loses no match.
2. Each window and each item gets a 64-bit SimHash of its shingles, weighted by their counts.
3. Fingerprints are cut into ``radius`` + 1 blocks. Two of them within ``radius`` bits agree in one
   block at least, so an equi-join on (window length, block, value) finds all of these. At similarity
   0.8 each bit differs with a chance of 0.15: more than 23 of 64 bits in one pair of 10**6.
4. The weighted similarity of each candidate is computed in full.

Words are runs of letters and digits, lower-cased. Items with fewer words than a shingle are one
shingle, as wide as they are. Null and wordless texts and items match nothing. Equal items are
matched once and reported by each id; a document row is known by its id and text, so rows with null
or repeated ids are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored

SHINGLE, PERCENT, RADIUS = 5, 80, 23
SMALL_ROWS = 1_000_000  # benchmark shingles up to this many are broadcast, more are joined by shuffle
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _grams(words: Column, width: int) -> Column:
    """Hashes of the ``width``-word shingles, in order; none if there are fewer words."""
    many = F.greatest(F.size(words), F.lit(1))
    moved = [words.alias("w0")] + [F.slice(words, i + 1, many).alias(f"w{i}") for i in range(1, width)]
    whole = F.slice(F.arrays_zip(*moved), 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(whole, lambda s: F.xxhash64(*[s[f"w{i}"] for i in range(width)]))


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text))


def simhash(rows: DataFrame, keys: list[str], gram: str) -> DataFrame:
    """``keys, fp``: the 64-bit SimHash over all ``gram`` hashes of each key; repeats add weight.

    Two bit counters of 31 bits share a long: ``sum`` over shifted bits j and j + 32.
    """
    low = F.lit((1 << 32) | 1)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.shiftrightunsigned(F.col(gram), j).bitwiseAND(low)).alias(f"_s{j}") for j in range(32)])
    fp = F.lit(0).cast("long")
    for j in range(32):
        first = F.col(f"_s{j}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_n")
        second = F.shiftrightunsigned(F.col(f"_s{j}"), 32) * 2 > F.col("_n")
        fp = fp.bitwiseOR(F.when(first, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
        top = (1 << (j + 32)) if j < 31 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(second, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def hamming_blocks(fp: Column, radius: int = RADIUS) -> Column:
    """Array of ``(block, value)``: the fingerprint in ``radius`` + 1 runs of bits, sizes as equal as can be."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _laid(starts: DataFrame, body: DataFrame, width: int) -> DataFrame:
    """``key, n_words, start, grams`` of each distinct window; the last one ends with its document. Repeated windows
    go by their numbers alone: a document's shingles meet its distinct windows in a join, which cuts them at once."""
    placed = starts.join(body.select("key", "size"), "key").withColumn("start", F.greatest(
        F.least("start", F.col("size") + (width - 1) - F.col("n_words")), F.lit(0)))
    return (placed.select("key", "n_words", "start").distinct().join(body.select("key", "grams"), "key")
            .select("key", "n_words", "start", F.slice("grams", F.col("start") + 1, F.col("n_words") - (width - 1)).alias("grams")))


def _matches(docs: DataFrame, items: DataFrame, width: int, percent: int, radius: int) -> DataFrame:
    """``key, item, start, window_words, inter, total`` of verified windows; ``items`` share a shingle width."""
    parts = items.select("item", "n_words", F.explode("grams").alias("g"))
    lookup = stored(parts.groupBy("item", "n_words", "g").agg(F.count(F.lit(1)).alias("weight")), "lookup")
    wanted = lookup.select("g").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_ROWS else wanted

    grams = docs.select("key", _words(F.col("text")).alias("w")).select("key", _grams(F.col("w"), width).alias("grams"))
    hits = stored(grams.select("key", F.posexplode_outer("grams").alias("p", "g")).join(wanted, "g")
                  .select("key", "p", "g"), "hits")
    need = items.select("item", F.ceil(F.size("grams") * (percent / 100) - 1e-9).cast("int").alias("need"))
    placed = (hits.join(lookup.select("item", "n_words", "g"), "g").groupBy("key", "item", "n_words")
              .agg(F.sort_array(F.collect_set("p")).alias("p")).join(need, "item").where("size(p) >= need"))
    # a window from s holds hits i .. i + need - 1 when p[i + need - 1] - reach <= s <= p[i]
    reach = F.col("n_words") - width
    last = F.slice("p", F.col("need"), F.size("p"))
    runs = F.slice(F.arrays_zip(F.col("p").alias("lo"), last.alias("hi")), 1, F.size("p") - F.col("need") + 1)
    runs = placed.select("key", "n_words", reach.alias("reach"), F.explode(runs).alias("r"))
    starts = runs.where("r.hi - r.lo <= reach").select(
        "key", "n_words", F.explode(F.sequence(F.greatest(F.col("r.hi") - F.col("reach"), F.lit(0)),
                                               F.col("r.lo"))).alias("start"))
    starts = stored(starts, "starts")
    leaking = stored(starts.select("key").distinct(), "leaking")
    # shingles are made again for the documents that may leak only; counted few, their keys are broadcast and no
    # other text is shuffled
    leaking = F.broadcast(leaking) if leaking.count() <= SMALL_ROWS else leaking
    bodies = docs.join(leaking, "key", "left_semi").select("key", _words(F.col("text")).alias("w"))
    body = (bodies.select("key", _grams(F.col("w"), width).alias("grams")).dropDuplicates(["key"])
            .withColumn("size", F.size("grams")))
    body = stored(body, "bodies")
    window = ["key", "n_words", "start"]
    laid = stored(_laid(starts, body, width), "laid")
    prints = stored(simhash(laid.select(*window, F.explode("grams").alias("g")), window, "g"), "prints")
    target = simhash(parts.select("item", "n_words", "g"), ["item", "n_words"], "g")
    mine = prints.select(*window, "fp", F.explode(hamming_blocks(F.col("fp"), radius)).alias("b")).select(*window, "fp", "b.*")
    theirs = target.select("item", "n_words", F.col("fp").alias("fp2"), F.explode(hamming_blocks(F.col("fp"), radius)).alias("b")
                           ).select("item", "n_words", "fp2", "b.*")
    near = (mine.join(theirs, ["n_words", "block", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius).select(*window, "item").distinct())

    counts = (near.join(laid, window).select(*window, "item", F.size("grams").alias("n"), F.explode("grams").alias("g"))
              .groupBy(*window, "item", "n", "g").agg(F.count(F.lit(1)).alias("c")))
    inter = (counts.join(lookup.select("item", "g", "weight"), ["item", "g"])
             .groupBy(*window, "item", "n").agg(F.sum(F.least("c", "weight")).alias("inter")))
    size = items.select("item", F.size("grams").alias("m"))
    return (inter.join(size, "item").withColumn("total", F.col("n") + F.col("m") - F.col("inter"))
            .where(F.col("inter") * 100 >= F.col("total") * percent)
            .select("key", "item", "start", (F.col("n") + (width - 1)).alias("window_words"), "inter", "total"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS,
          id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row key and benchmark item it leaks: ``key, doc_id, item_id, start_word, window_words,
    similarity`` of the most similar window (the first of equals)."""
    source = docs.select(row_key(id_col, text).alias("key"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    named = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("w")).where("size(w) > 0")
    named = named.select("item_id", F.xxhash64("w").alias("item"), "w")
    distinct = named.groupBy("item").agg(F.any_value("w").alias("w")).withColumn("n_words", F.size("w"))
    distinct = stored(distinct.withColumn("width", F.least("n_words", F.lit(SHINGLE))), "items")
    found = None
    for width in sorted(r.width for r in distinct.select("width").distinct().collect()):  # at most five
        items = distinct.where(F.col("width") == width).select("item", "n_words", _grams(F.col("w"), width).alias("grams"))
        part = stored(_matches(source.select("key", "text"), stored(items, "grams"), width, percent, radius), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.where(F.lit(False)).select(
            "key", "doc_id", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("window_words"), F.lit(0.0).alias("similarity"))
    ratio = F.col("inter") / F.col("total")
    best = (found.groupBy("key", "item").agg(F.max_by(F.struct("start", "window_words", ratio.alias("similarity")),
                                                      F.struct(ratio, -F.col("start"))).alias("b")))
    best = best.join(named.select("item", "item_id").distinct(), "item")
    return (source.select("key", "doc_id").distinct().join(best, "key")
            .select("key", "doc_id", "item_id", F.col("b.start").alias("start_word"), "b.window_words", "b.similarity"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that leak no item."""
    keyed = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    ident, body = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    bad = leaks(docs.select("doc_id", "text"), benchmark, **options).select("key").distinct()
    bad = stored(bad, "bad")
    keep = keyed.withColumn("key", row_key(ident, body)).join(bad, "key", "left_anti").drop("key")
    return keep.toDF(*docs.columns)
