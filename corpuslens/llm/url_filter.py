"""URL verdicts from rules and, where no rule fits, from trust and distrust over the host link graph.

Rules are ``(verdict, host, path)``: a rule fits its host and all subdomains when the url's path
starts with the rule's; the longest rule wins (then the longest host, then block). Pages that a rule
allows seed trust on their host, pages that a rule blocks seed distrust. Trust is a personalised
PageRank along host links, distrust one along reversed links, so hosts that trusted hosts link to
gain trust and hosts that link to blocked ones gain distrust. A host is blocked when its distrust is
over ``ratio`` times its trust.

Null urls and urls without ``://`` have an empty host and path, take part in no link and are
allowed. Links are absolute or protocol-relative ``href`` targets; a null html has none. Hot
hosts: links are counted per host pair before the shuffle, the joins are equi-joins with one row per
host on one side, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, stored

# The rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_RULES = 1000  # rules become one expression; a longer list belongs into a table
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING, TOLERANCE, RATIO = 0.7, 0.01, 2.0


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    host = ascii_lower(F.regexp_extract(url, pattern, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def best_rule(rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the winning rule over columns ``host`` and ``path``, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(ranked):
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        found = F.when(fits & F.col("path").startswith(path),
                       F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` between different hosts from ``pages(host, html)``."""
    target = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), target)
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def page_rank(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, rank``: personalised PageRank from ``seeds(host, seed)``, whose seeds sum to one.

    Rank that reaches a host without links goes back to the seeds. Each round is written to the
    shared folder; rounds end when no host's rank has changed by more than ``tolerance`` of itself, so the hosts of
    little rank are as settled as the others. Damping forces that once the seeds' rank has come everywhere it can.
    """
    out = links.groupBy("src").agg(F.sum("weight").alias("_out"))
    share = stored(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "share")
    rank = stored(seeds.select("host", F.col("seed").cast("double").alias("rank")), "rank")
    start = rank
    while True:
        moved = (rank.join(share, rank["host"] == share["src"]).groupBy("dst")
                 .agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("got")))
        back = 1.0 - (moved.agg(F.sum("got").alias("s")).first().s or 0.0)
        fresh = (start.select("host", (F.col("rank") * back).alias("got"))
                 .unionByName(moved.select(F.col("dst").alias("host"), "got"))
                 .groupBy("host").agg(F.sum("got").alias("rank")))
        fresh = stored(fresh, "rank")
        both = fresh.select("host", F.col("rank").alias("new"), F.col("rank").alias("d")).unionByName(
            rank.select("host", F.lit(0.0).alias("new"), (-F.col("rank")).alias("d")))
        moved = both.groupBy("host").agg(F.sum("new").alias("new"), F.sum("d").alias("d"))
        rank = fresh
        if moved.where(F.abs("d") > F.col("new") * tolerance).isEmpty():
            break
    return rank


def _seeds(ruled: DataFrame, verdict: str) -> DataFrame:
    hits = ruled.where((F.col("verdict") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = hits.agg(F.sum("n").alias("t")).first().t or 1
    return hits.select("host", (F.col("n") / F.lit(total)).alias("seed"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
               ratio: float = RATIO) -> DataFrame:
    """One row per row of ``pages``: id, ``host, path, rule, verdict, trust, distrust``."""
    host, path = split_url(F.col(url).cast("string"))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    found = split.withColumn("_best", best_rule(rules))
    ruled = stored(found.select("page_id", "host", "path", F.col("_best.rule"), F.col("_best.verdict")), "ruled")
    links = stored(host_links(split.select("host", "html")), "links")
    trust = page_rank(links, _seeds(ruled, "allow")).withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = page_rank(back, _seeds(ruled, "block")).withColumnRenamed("rank", "distrust")
    scores = trust.join(distrust, "host", "full")
    zero = F.lit(0.0)
    judged = ruled.join(scores, "host", "left").withColumns(
        {"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    method = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")
