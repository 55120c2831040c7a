"""Main text of web pages by site template removal.

Every element subtree gets a hash of its tags and text. Spark counts, per host, in how many different
page bodies (the kept text before templates go) each subtree occurs, so that copies of a page count
once; one that is in at least ``share`` of the host's bodies (and in ``min_pages``) is
site template and is deleted from all pages. A host has at most (subtrees a page) / share of
these, so its list joins the pages as one row. Elements that never hold an article's text (menus,
forms, scripts, adverts and so on, by tag, role, class or id) go without counting.

If the page has an ``article`` (else a ``main``), only its content counts, and an element round it is
never template. There, headings, paragraphs, lists and the like are the writer's own words: they
stay even where they recur; other recurring containers go. Without either, all recurring subtrees
of the body go.

Null and empty pages give an empty text. Unclosed, misnested and cut off markup is read as browsers do
in the cases that occur in practice; nothing is too long or too deep, the work is in proportion to the page. Rows that repeat an id are
extracted each on its own, and count once each.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, by_bytes, in_python, stored

SHARE, MIN_PAGES = 0.1, 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>"""
                   r"""|</?[a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s
samp small span strike strong sub sup time tt u var""".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody tr td th figure figcaption hr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("article section main div body html td th table ul ol dl blockquote aside nav form figure".split())

ENDS_INSIDE = frozenset("p li h1 h2 h3 h4 h5 h6".split())  # their end tags stop at a barrier, as those of INLINE do

NEVER = frozenset("""head script style noscript template iframe svg canvas object nav footer aside form button select
textarea input dialog menu title""".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())
NEVER_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar
navigation breadcrumb breadcrumbs footer comment comments reply replies disqus share sharing social related recommended
widget login signup search""".split())


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            words = [set(re.split("[_-]+", word)) for word in value.split()]
            if any(w <= NEVER_NAMES if in_article else w & NEVER_NAMES or "header" in w for w in words):
                return True
        elif name == "role" and value in NEVER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Page:
    """Text pieces of a page, in order, and its element subtrees as ranges of pieces.

    ``pieces[i]`` is text, or None where a block begins or ends. ``spans`` are the outermost ranges
    that count: articles, else mains, else everything. ``subtrees`` holds
    ``(hash, first piece, end piece, may be template)`` of elements with text outside boilerplate;
    only elements within a span that are neither round one nor the writer's own words may.
    """

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.regions: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self._open: list[list] = []  # tag, first piece, digest, own text seen, boilerplate
        self._places: dict[str, list[int]] = {}  # of the open elements, by tag
        self._dropped = 0
        self._articles = 0
        self._read(source)
        self.spans: list[tuple[int, int]] = []
        for span in sorted(self.regions["article"] or self.regions["main"], key=lambda x: (x[0], -x[1])):
            if not self.spans or span[0] >= self.spans[-1][1]:
                self.spans.append(span)
        self.spans = self.spans or [(0, len(self.pieces))]
        named = bool(self.regions["article"] or self.regions["main"])
        self.subtrees = [(own, first, end, may and self._within(first, end, named))
                         for own, first, end, may in self.subtrees]

    def _within(self, first: int, end: int, named: bool) -> bool:
        """Does the range lie in a span, without holding all of a named one?"""
        at = bisect_left(self.spans, (first + 1,)) - 1
        if at < 0 or end > self.spans[at][1]:
            return False
        return not named or (first, end) != self.spans[at]

    def _text(self, raw: str) -> None:
        if self._dropped or not raw:
            return
        text = references.unescape(raw)
        self.pieces.append(text)
        if self._open:
            squeezed = " ".join(text.split())
            if squeezed:
                self._open[-1][2].update(b"t" + squeezed.encode("utf-8", "surrogatepass") + b"\0")
                self._open[-1][3] = True

    def _break(self, tag: str) -> None:
        if tag not in INLINE and not self._dropped:
            self.pieces.append(None)

    def _push(self, tag: str, attributes: str) -> None:
        for opener in self._implied(tag):
            self._close_to(opener)
        self._break(tag)
        bad = _boilerplate(tag, attributes, self._articles > 0)
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append([tag, len(self.pieces), hashlib.blake2b(tag.encode(), digest_size=8), False, bad])
        self._dropped += bad
        self._articles += tag in self.regions

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def _implied(self, tag: str) -> Iterator[int]:
        """Places of open elements that a start tag closes: the last of its kind, and an open paragraph."""
        own = CLOSES.get(tag, frozenset())
        for closed in ([own] if own else []) + ([{"p"}] if tag not in INLINE else []):
            at = self._last(closed)
            if at > self._last(BARRIER - closed - own):
                yield at

    def _close_to(self, at: int) -> None:
        while len(self._open) > at:
            tag, first, digest, text, bad = self._open.pop()
            self._places[tag].pop()
            self._dropped -= bad
            self._articles -= tag in self.regions
            if tag in self.regions and not self._dropped:
                self.regions[tag].append((first, len(self.pieces)))
            if text and not bad and not self._dropped:
                own = digest.digest()
                inside = self._articles > 0 and (tag in FLOW or tag in INLINE) or tag in self.regions
                may = not inside and tag not in ("html", "body")
                self.subtrees.append((int.from_bytes(own, "little", signed=True), first, len(self.pieces), may))
                if self._open:
                    self._open[-1][2].update(b"e" + own)
                    self._open[-1][3] = True
            self._break(tag)

    def _end(self, tag: str) -> None:
        stops = BARRIER if tag in INLINE or tag in ENDS_INSIDE else frozenset()
        if tag not in ("html", "body", "main"):
            stops = stops | {"article", "main", "body"}
        at = self._last([tag])
        if at > self._last(stops - {tag}):
            self._close_to(at)
        else:
            self._break(tag)

    def _read(self, source: str) -> None:
        at = 0
        while token := TOKEN.search(source, at):
            self._text(source[at:token.start()])
            at = token.end()
            tag = (token[2] or "").lower()
            if not tag:
                continue
            if token[1]:
                self._end(tag)
            elif tag in VOID:
                self._break(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif token[3].endswith("/") and tag in ("svg", "path", "use"):
                continue
            else:
                self._push(tag, token[3])
        self._text(source[at:])
        self._close_to(0)

    def text(self, templates: set[int]) -> str:
        """The kept text: blocks in page order, white space squeezed, joined by one space."""
        keep = np.zeros(len(self.pieces), dtype=bool)
        for first, end in self.spans:
            keep[first:end] = True
        for own, first, end, may in self.subtrees:
            if may and own in templates:
                keep[first:end] = False
        joined = "".join(" " if p is None or not k else p for p, k in zip(self.pieces, keep))
        return " ".join(joined.split())

    def body(self) -> int:
        """Hash of the kept text before templates go: copies of a page have the same."""
        own = hashlib.blake2b(self.text(set()).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return int.from_bytes(own, "little", signed=True)


def host_of(url):
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, templates``: hashes of subtrees in many different bodies of the host. ``pages`` has ``host, html``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "html"):
            hosts, read = [], []
            for host, h in zip(frame["host"], frame["html"]):
                if isinstance(h, str):
                    hosts.append(host)
                    read.append(Page(h))
            yield pd.DataFrame({"host": hosts, "body": [p.body() for p in read],
                                "subtrees": [sorted({s[0] for s in p.subtrees if s[3]}) for p in read]})

    seen = stored(in_python(pages, run, "host string, body long, subtrees array<long>").distinct(), "subtrees")
    total = seen.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (seen.select("host", "body", F.explode("subtrees").alias("subtree")).distinct()
              .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    return (counts.join(total, "host").where(F.col("n") >= F.col("pages") * share)
            .groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates")))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
            share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                          F.col(html).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    templates = stored(site_templates(source.select("host", "html"), share, min_pages), "templates")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_bytes(frames, "html"):
            texts = [Page(h).text(set() if t is None else set(t)) if isinstance(h, str) else ""
                     for h, t in zip(frame["html"], frame["templates"])]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts})

    return in_python(source.join(templates, "host", "left"), run, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
