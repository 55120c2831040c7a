import hashlib
import itertools
import math
import pickle
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, html_extract, lang_id, packing, pii, quality, url_filter

from .conftest import SMALL, hard_rows
from .test_dedup import got


# packing

def encode(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    return ["", "a b c\u0085d", "It's  we'll\tI'd 've", "<|endoftext|> x <|startoftext|>y", "é É ﬁ ﬀ", "漢字かな交じり",
            "\U0001f600‍\U0001f4bb ok", "a\x1cb\x0bc\x1fd", "İI ı ſ ß", "x" * 3000, "don't 'S 'Re", " 　 ", "नमस्ते दुनिया", "a<|startoftext|>b, ,a"]


def test_word_encoder_equals_whole_text_encoding(small_docs):
    texts = odd_texts() + [r.text for r in small_docs.collect()]
    own = packing.WordEncoder(packing.tokenizer_path())
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in own.encode([t.encode() for t in texts])] == encode(texts)


def test_word_encoder_stems_and_generations(monkeypatch):
    """Random chunks of letters, punctuation, marks and special tokens, with a cache that turns over often."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    own, rnd = packing.WordEncoder(packing.tokenizer_path()), random.Random(3)
    signs = list("aAbzZ09.,'!-_<|>()sStTrRéÉßİıſKﬁñ\u0301\u0307Ωσς你好😀½²\u00a0\u2003\u0085\u200b%$@#") + [
        own.parting, own.parting.upper() + ".", "it's", "I'M."]
    texts = [" ".join("".join(rnd.choices(signs, k=rnd.randint(1, 9))) for _ in range(6)) for _ in range(1500)]
    found = [x for at in range(0, len(texts), 20) for x in own.encode([t.encode() for t in texts[at:at + 20]])]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in found] == encode(texts)


@pytest.mark.parametrize("total,longest,want", [(1, 8, [1]), (8, 8, [8]), (29, 8, [8, 8, 8, 4, 1]), (7, 8, [4, 2, 1])])
def test_piece_lengths(total, longest, want):
    assert packing.piece_lengths(total, longest) == want


def test_pack_round_trip(docs_of, small_docs):
    rows = hard_rows() + [(1000 + r.doc_id, r.text) for r in small_docs.collect()]
    out = packing.pack(docs_of(rows)).collect()
    want = Counter((i, tuple(ids)) for (i, _), ids in zip(rows, encode([t or "" for _, t in rows])))
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    by_doc = {}
    for r in out:
        ids = struct.unpack(f"<{r.length}I", bytes(r.ids_le))
        assert r.length & (r.length - 1) == 0 and r.length <= 2048
        by_doc.setdefault((r.doc_id, r.doc_tokens), Counter())[(r.start, ids)] += 1
    for (doc, ids), times in want.items():
        at, parts = 0, by_doc[doc, len(ids)]
        for n in packing.piece_lengths(len(ids)):
            assert parts[at, ids[at:at + n]] >= times
            at += n
    digest = packing.pack_digest(docs_of(rows)).collect()
    crc = Counter((r.doc_id, r.start, zlib.crc32(bytes(r.ids_le))) for r in out)
    assert crc == Counter((r.doc_id, r.start, r.ids_crc32) for r in digest)
    assert packing.pack_digest(docs_of([])).count() == 0


# language

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = lang_id.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(docs_of):
    train = [(i, t, lang) for i in range(40) for t, lang in [("the cat and dog of house", "en"), ("der hund und die katze", "de")]]
    docs = docs_of(train + [(100, None, None), (101, "12 !?", "en"), (102, "", "en"), (103, "thee catt", None), (None, "katzen", "de")])
    out = {r.doc_id: r for r in lang_id.identify(docs).collect()}
    assert [out[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and out[100].score == 0.0
    assert out[103].lang_pred == "en" and out[None].lang_pred == "de" and out[None].held_out is False
    kept = lang_id.filter_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102})
    assert {r.lang_pred for r in lang_id.identify(docs_of([(1, "text here", None)])).collect()} == {"und"}
    assert lang_id.identify(docs_of([])).count() == 0 and lang_id.identify(docs_of(hard_rows())).count() == len(hard_rows())


def test_language_with_three_documents(spark):
    """A language of little text takes no documents from the others, and keeps its own words in the model."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    few = [r.doc_id for r in docs.where("lang = 'fr'").where(~lang_id.held_out()).orderBy("doc_id").limit(3).collect()]
    assert len(few) == 3
    docs = docs.where((docs["lang"] != "fr") | docs["doc_id"].isin(few))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in lang_id.identify(docs).collect() if r.held_out and truth[r.doc_id] != "fr"]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_small_language_keeps_its_words(spark):
    rows = [("en", f"w{i:03d}", 100) for i in range(50)] + [("fr", f"v{i}", 10 - i) for i in range(8)]
    counts = spark.createDataFrame(rows, "lang string, word string, n long").repartition(3)
    kept = set(lang_id._largest(counts, F.lit(0), 10, ["en", "fr"]).names.split("\n"))
    assert kept == {f"w{i:03d}" for i in range(10)} | {f"v{i}" for i in range(5)}


def test_backoff_uses_shorter_grams():
    words = lang_id.Table(["abc", "xyz"], np.array([0, 0]), np.array([[5, 0], [0, 5]]), {0: np.array([5, 5])})
    grams = lang_id.Table(["q", "zz"], np.array([1, 2]), np.array([[3, 0], [0, 4]]), {1: np.array([3, 0]), 2: np.array([0, 4])})
    model = pickle.loads(pickle.dumps(lang_id.Model(words, grams, ["a", "b"])))
    assert model.predict(["abc", "zz", None, "q"])[0] == ["a", "b", "und", "a"]


def restated_language(rows):
    """Every document's language and posterior, by the module's description and without its bounds."""
    letters = lambda t: ["".join(g) for k, g in itertools.groupby((t or "").lower(), str.isalpha) if k]
    count = defaultdict(Counter)  # (kind, item) to languages
    for i, t, lang in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            for w in letters(t):
                count[0, w][lang] += 1
    langs = sorted({x for c in count.values() for x in c})
    for (_, w), c in list(count.items()):
        for size in range(1, 6):
            for at in range(len(w) + 3 - size):
                if f" {w} "[at:at + size] != " ":
                    count[size, f" {w} "[at:at + size]].update(c)
    kinds, total = Counter(k for k, _ in count), defaultdict(Counter)
    for (k, _), c in count.items():
        total[k].update(c)

    def known(k, item):
        return np.array([math.log(count[k, item][x] + 0.5) - math.log(total[k][x] + 0.5 * (kinds[k] + 1)) for x in langs])

    def unseen(piece, depth):
        if (len(piece), piece) in count:
            return known(len(piece), piece) + depth * math.log(0.4)
        return np.zeros(len(langs)) if len(piece) == 1 else (unseen(piece[:-1], depth + 1) + unseen(piece[1:], depth + 1)) / 2

    def word(w):
        if (0, w) in count:
            return known(0, w)
        return np.mean([unseen(f" {w} "[i:i + 5], 0) for i in range(max(1, len(w) - 2))], axis=0)

    out = []
    for i, t, _ in rows:
        score = sum(word(w) for w in letters(t)) if langs and letters(t) else None
        out.append((i, "und", 0.0) if score is None else
                   (i, langs[int(np.argmax(score))], 1 / sum(math.exp(max(x - max(score), -700)) for x in score)))
    return out


def test_language_equals_its_restatement(docs_of, spark):
    train = [(r.doc_id, r.text[:600], r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    odd = [(9001, "²", None), (9002, "² ½", None), (9003, "① Ⅷ ٣", None), (9004, "x² y½", "en"), (9005, "Zzzxq Qqqwv", None),
           (9006, None, "de"), (None, "Ünd der", "de"), (9007, "Ünseen-wörds 7up", None), (9008, "e", None)]
    rows = train + odd
    want = Counter((i, lang, round(p, 6)) for i, lang, p in restated_language(rows))
    out = lang_id.identify(docs_of(rows).withColumns({"word": F.lit("x"), "kind": F.lit(1), "n": F.lit(2), "score": F.lit(0.1)}))
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in out.collect()) == want
    und = {i for i, lang, _ in want if lang == "und"}
    assert und == {9001, 9002, 9003, 9006}


def test_language_tie_goes_to_the_first_name(docs_of):
    docs = docs_of([(i, "same words", lang) for i in range(12) for lang in ("b", "a")] + [(99, "same", None), (98, "other", None)])
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(docs).collect()}
    assert out[99] == out[98] == ("a", 0.5)


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p><b>First
 part.<br><p>Second&nbsp;part, <i>in</i>line<b>d</b>. &lt;x&gt;</p><div class="ad">Buy</div><aside>Side</aside>
<ul><li>one<li>two</ul><form><p>Form</p></form><section id="comments"><p>Nice!</p></section><p>5 < 6 and</p></article>
<div class="tail">Recurring %s</div><footer>&copy; me</footer></body>"""


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_main_text(spark):
    rows = [(1, "http://A.b/x", PAGE), (2, "http://a.b/y", None), (3, None, ""), (4, "http://a.b", "<p>bare <p>text<"),
            (None, "x", "<article>cut off <b>here <p"), (5, "http://c/", "<main><p>m</p></main><p>outside</p>"), (5, "http://c/", "<div>" * 3000 + "deep")]
    out = {(r.page_id, r.text): r.n_chars for r in html_extract.main_text(page_table(spark, rows)).collect()}
    want = "Head & line First part. Second part, inlined. <x> one two 5 < 6 and"
    assert set(out) == {(1, want), (2, ""), (3, ""), (4, "bare text<"), (None, "cut off here"), (5, "m"), (5, "deep")}
    assert out[1, want] == len(want)
    assert html_extract.main_text(page_table(spark, [])).count() == 0


def test_site_templates_go_by_host(spark):
    same = "<div><span>Follow us</span></div>"
    rows = [(i, f"http://big.site/{i}", f"<body>{same}<div>own words {i}</div></body>") for i in range(8)]
    rows += [(20 + i, f"http://s{i}.site/", f"<body>{same}<div>page {i}</div></body>") for i in range(8)]
    rows += [(50 + i, "http://art.site/", f"<article><p>Shared line.</p><div>Sign here</div><p>n{i}</p></article>") for i in range(8)]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    assert out[3] == "own words 3" and out[24] == "Follow us page 4" and out[52] == "Shared line. n2"


def test_blocks_on_some_pages_and_on_small_hosts_go(spark):
    rows = [(i, "http://ten.site/", f"<body>{'<div>Spring sale banner</div>' if i < 4 else ''}<div>own words {i}</div></body>") for i in range(10)]
    rows += [(20 + i, "http://four.site/", f"<body><div>Site banner</div><article><p>words {i}</p></article><div>x{i}</div></body>") for i in range(4)]
    rows += [(30 + i, "http://plain.site/", f"<body><div>Site banner</div><div>words {i}</div></body>") for i in range(4)]
    rows += [(40 + i, "http://three.site/", f"<body><div>Only thrice</div><div>words {i}</div></body>") for i in range(3)]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    assert out[0] == "own words 0" and out[9] == "own words 9" and out[21] == "words 1" and out[32] == "words 2"
    assert out[40] == "Only thrice words 0"
    plain = html_extract.extract(page_table(spark, rows), min_pages=100)  # the counting off
    assert {r.page_id: r.text for r in plain.collect()}[0] == "Spring sale banner own words 0"


def test_names_inside_an_article_must_be_whole(spark):
    inner = ("<div class='related-history'>One.</div><section id='notice-of-war'>Two.</section><div class='ad'>A</div>"
             "<div class='story cookie-notice'>B</div><section id=comments>C</section><p class='menu_card_design'>Three.</p>")
    rows = [(1, "http://a.b/", f"<article>{inner}</article>"), (2, "http://c.d/", f"<body>{inner}</body>")]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    assert out == {1: "One. Two. Three.", 2: ""}


@pytest.mark.parametrize("markup", ["<x>", "<b></i>", "<div></p>", "<p><b>", "<li>", "<td><p>", "<article>"])
def test_deep_pages_take_time_in_proportion(markup):
    import time
    def seconds(n):
        begin = time.process_time()
        html_extract.Page("<body>" + markup * n + "deep")
        return time.process_time() - begin
    seconds(500)
    assert seconds(40_000) < 12 * seconds(8_000) + 0.5  # in proportion is 5 times, its square 25


class Dom(HTMLParser):
    """Plain reader of well-formed pages: nested lists [tag, attributes, child...]."""

    def __init__(self, source):
        super().__init__()
        self.root = ["root", {}]
        self.stack = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs)]
        self.stack[-1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1].append(data)


def dom_text(source, templates=frozenset()):
    """(text, names of its subtrees that may be template), by recursion over the tree."""
    may, texts = set(), []

    def name(node):  # tags and text; elements without text do not count
        if isinstance(node, str):
            return " ".join(node.split()) or None
        if node[0] in ("nav", "footer") or node[1].get("class") == "ad":
            return None
        inner = [x for x in map(name, node[2:]) if x]
        return (node[0], *inner) if inner else None

    def walk(node, keep, inside):
        if isinstance(node, str):
            texts.append(node if keep else "")
            return
        own = name(node)
        if own is None:
            texts.append(" ")
            return
        tag = node[0]
        flow = tag in html_extract.FLOW or tag in html_extract.INLINE
        if keep and tag not in ("html", "body", "article", "root") and not (inside and flow) and not holds(node):
            may.add(own)
            keep = own not in templates
        texts.append("" if tag in html_extract.INLINE else " ")
        for child in node[2:]:
            walk(child, keep, inside or tag == "article")
        texts.append("" if tag in html_extract.INLINE else " ")

    def holds(node):
        return not isinstance(node, str) and (node[0] == "article" or any(holds(x) for x in node[2:]))

    def starts(node):
        if isinstance(node, str):
            return []
        return [node] if node[0] == "article" else [y for x in node[2:] for y in starts(x)]

    root = Dom(source).root
    for top in starts(root) or [root]:
        walk(top, True, False)
        texts.append(" ")
    return " ".join("".join(texts).split()), may


def random_page(rnd, shared):
    def tree(depth, inside):
        if depth == 0 or rnd.random() < 0.25:
            return f"w{rnd.randint(0, 10**6)}" if rnd.random() < 0.6 else rnd.choice(shared)
        tag = rnd.choice(["div", "section", "div", "span", "b", "h2"])
        body = "".join(tree(depth - 1, inside) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 3)))
        if rnd.random() < 0.3:
            body = rnd.choice(shared)
        extra = ' class="ad"' if rnd.random() < 0.05 else ""
        return f"<{tag}{extra}>{body}</{tag}>"
    parts = [tree(3, False) for _ in range(rnd.randint(1, 4))]
    if rnd.random() < 0.6:
        parts.insert(rnd.randint(0, len(parts)), f"<article>{''.join(tree(3, True) for _ in range(3))}</article>")
    return f"<html><body><nav>Menu</nav>{''.join(parts)}<footer>foot</footer></body></html>"


def test_templates_equal_a_plain_tree_reader(spark):
    rnd = random.Random(11)
    rows = []
    for host, n in enumerate((1, 4, 9, 60)):
        shared = [f"shared {host} {i}" for i in range(6)]
        rows += [(host * 1000 + i, f"http://h{host}.x/{i}", random_page(rnd, shared)) for i in range(n)]
        rows += [(host * 1000 + 500 + i, f"http://h{host}.x/{i}", rows[-1][2]) for i in range(3)]  # copies count once
    want, without = {}, {}
    for host in range(4):
        own = [(i, h) for i, u, h in rows if f"//h{host}." in u]
        seen = defaultdict(set)
        bodies = set()
        for _, h in own:
            text, may = dom_text(h)
            bodies.add(text)
            for m in may:
                seen[m].add(text)
        gone = {m for m, b in seen.items() if len(b) >= html_extract.MIN_PAGES and len(b) >= html_extract.SHARE * len(bodies)}
        for i, h in own:
            want[i], without[i] = dom_text(h, gone)[0], dom_text(h)[0]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    assert out == want and sum(want[i] != without[i] for i in want) > 20


def test_copies_of_a_page_are_no_template(spark):
    """Six copies among eight pages of a host, with and without an article, and with other text beside it."""
    def page(text, beside="", tag="article"):
        return f"<html><body><nav>Menu</nav><div><{tag}><div><div>{text}</div></div></{tag}></div>{beside}</body></html>"

    rows = [(i, "http://a.b/", page("Copied words" if i < 6 else f"own words {i}")) for i in range(8)]
    rows += [(10 + i, "http://c.d/", page("Copied words" if i < 6 else f"own words {i}", tag="div")) for i in range(8)]
    rows += [(20 + i, "http://e.f/", page("Copied words" if i < 6 else f"own words {i}", f"<div>beside {i}</div>")) for i in range(8)]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    for first in (0, 10, 20):
        assert [out[first + i] for i in range(8)] == ["Copied words"] * 6 + ["own words 6", "own words 7"]


def test_articles_side_by_side_keep_their_wrapper(spark):
    rows = [(i, "http://a.b/", f"<div><article>Lead</article></div><article>own words {i}</article>") for i in range(8)]
    out = {r.page_id: r.text for r in html_extract.main_text(page_table(spark, rows)).collect()}
    assert out == {i: f"Lead own words {i}" for i in range(8)}


def test_urls(spark):
    rows = [(1, "https://Sub.Example.org/es/1?q", None), (2, "http://example.org/en/12#x", ""), (3, "http://x.org", None), (4, "http://x.org/", None),
            (5, "ftp://notcom/fr/", None), (6, "http://a.com/fr/://z", None), (7, "http://a.com/de/1", None), (8, None, None), (9, "no host", None),
            (None, "http://q.net/a", '<a href="http://bad.com/de/">x</a>'), (11, "http://bad.com/de/2", None), (12, "http://bad.com/xx", None),
            (13, "http://example.org/en/2", None), (13, "http://example.org/en/2", None)]
    out = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(page_table(spark, rows)).collect())
    assert out == Counter([
        (1, "sub.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "x.org", "", None, "allow"), (4, "x.org", "/", "org/", "allow"), (5, "notcom", "/fr/", None, "allow"),
        (6, "a.com", "/fr/://z", "com/fr/", "allow"), (7, "a.com", "/de/1", "com/de/", "block"), (8, "", "", None, "allow"),
        (9, "", "", None, "allow"), (None, "q.net", "/a", None, "block"), (11, "bad.com", "/de/2", "com/de/", "block"),
        (12, "bad.com", "/xx", None, "block"), (13, "example.org", "/en/2", "org/", "allow"), (13, "example.org", "/en/2", "org/", "allow")])
    assert url_filter.judge_urls(page_table(spark, [])).count() == 0


def test_page_rank_equals_dense_solution(spark):
    import numpy as np
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1), ("b", "e", 3)]
    out = {r.host: r["rank"] for r in url_filter.page_rank(spark.createDataFrame(edges, "src string, dst string, weight long"),
           spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, seed double"), tolerance=1e-9).collect()}
    names = "abcde"
    move = np.zeros((5, 5))
    for s, t, w in edges:
        move[names.index(t), names.index(s)] = w / sum(x[2] for x in edges if x[0] == s)
    seed, r = np.array([.5, 0, 0, .5, 0]), np.array([.5, 0, 0, .5, 0])
    for _ in range(200):
        m = url_filter.DAMPING * move @ r
        r = m + (1 - m.sum()) * seed
    assert all(abs(out.get(n, 0) - r[i]) < 1e-6 for i, n in enumerate(names))


# personal data

def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


ODD = ["a@b.com_x@y.org z@q", "1.2.3.4.5.6.7.8 999.1.2.3.4 0001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (337) 555-9217. +12 345",
       "\U0001f600 ü a.b@c.d.e 10.0.0.1", "4" * 16 + " " + "5 " * 9, "1-" * 5000 + "1", "@@@ a@.b a@b.c@d.e", "x@y.z +49 (30) 1234567 ", "..@a.b+1 22 333 4444"]


def test_personal_data_base_spans(docs_of, spark):
    rows = hard_rows() + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = pii.personal_data_digest(docs_of(rows)).collect()
    seen = sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out], key=repr)
    want = []
    for i, t in rows:
        s = brute_spans(t)
        n = Counter(k for k, _, _ in s)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert seen == sorted(want, key=repr)
    assert pii.personal_data_digest(docs_of([])).count() == 0


def test_personal_data_context(docs_of):
    rows = [(i, f"write mailto: user{i}@host.org now") for i in range(12)] + [(50, "mailto: local-7 or ring"), (51, "the local-7 the 12")]
    rows += [(60 + i, f"the user{i}x@host.org") for i in range(12)] + [(90 + i, "the end the way the sea") for i in range(30)]
    out = {r.doc_id: r.spans for r in pii.personal_data_digest(docs_of(rows)).collect()}
    assert out[50] == "context:8:15" and out[51] == "" and out[0] == "email:14:28" and out[95] == ""


def test_personal_data_second_generation(docs_of):
    """'member' stands before learned instances only; the word before many blanks counts."""
    rows = [(i, f"mailto: user{i}@host.org") for i in range(100)] + [(200 + i, f"mailto: acct-{i}") for i in range(20)]
    rows += [(300 + i, f"member acct-{i}") for i in range(20)] + [(400, "member acct-999"), (401, "member" + " " * 200 + "acct-998")]
    rows += [(500, "x" * 90 + "member acct-997"), (501, "other acct-3")]
    out = {r.doc_id: r.spans for r in pii.personal_data_digest(docs_of(rows)).collect()}
    assert out[200] == "context:8:14" and out[300] == "context:7:13" and out[400] == "context:7:15"
    assert out[401] == "context:206:214" and out[500] == "" and out[501] == ""


def test_bootstrap_equals_plain_rounds(docs_of):
    """The same trusted patterns as a plain loop over all words that runs to the fixed point."""
    rnd = random.Random(6)
    rows = []
    for i in range(900):
        word = rnd.choice(["mail", "reach", "member", "id", "ref", "note", "box"])
        far = {"mail": 0, "reach": 1, "member": 2, "id": 3, "ref": 4, "note": 5, "box": 3}[word]
        mark = f"u{i}@h.org" if far == 0 and rnd.random() < .85 else f"k{rnd.randrange(6)}-{max(far - (rnd.random() < .97), 0)}"
        rows.append((i, f"{word} {mark}" if word != "box" or i % 3 else "box empty"))
    graph, total = Counter(), Counter()
    for _, t in rows:
        total.update(t.split())
        left, token = t.split()
        if re.search("[0-9@]", token):
            graph[left, token] += 1
    score, good = {t: 1.0 * ("@" in t) for _, t in graph}, {}
    for _ in range(200):
        good = {p: c for p in {p for p, _ in graph} if (c := sum(n * score[t] for (q, t), n in graph.items() if q == p) / total[p]) >= 0.8
                and sum(score[t] > 0 for q, t in graph if q == p) >= 5}
        score = {t: 1.0 if "@" in t else max([good.get(p, 0.0) for p, u in graph if u == t]) for t in score}
    docs = docs_of(rows).selectExpr("doc_id as key", "text")
    got = {r.pattern: r.confidence for r in pii.bootstrap(pii._instances(pii.matches(docs)), docs).collect()}
    assert got.keys() == good.keys() and "reach" in got and all(abs(got[p] - good[p]) < 1e-6 for p in got)


# quality

def test_quality_separates_junk(spark):
    import duckdb
    out = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), sample=1000).toPandas()
    labels = duckdb.sql("select * from '/root/testdata/sf0.01/labels.parquet'").df().merge(out, on="doc_id")
    assert len(out) == 1000 and (labels.kept == (labels.quality == 1)).mean() > 0.97


def test_quality_edges(docs_of):
    out = quality.quality(docs_of(hard_rows())).collect()
    assert len(out) == len(hard_rows())
    assert all(r.score == 0.0 and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert quality.quality(docs_of([])).count() == 0


def test_training_rows_are_sparse_features(docs_of):
    """8,000 documents are learned from, as buckets and shares made in the tasks; no text is collected."""
    import numpy as np
    assert quality.SAMPLE == 8_000
    texts = ["", "one two one", "ONE, two! two", "x" * 5000, " ".join(f"w{i % 700}" for i in range(9000))]
    out = quality.training_rows(docs_of(list(enumerate(texts))).selectExpr("doc_id as key", "text", "0.5D as weak_label"))
    assert out.columns == ["key", "cells", "shares", "weak_label"]
    for r in out.collect():
        raw = [texts[r.key].encode()]
        words, at = quality.word_hashes(raw)
        counts = Counter(c + i * (1 << quality.BITS) for i, part in enumerate(quality.features(raw, words, at)) for c in part.tolist())
        cells, shares = np.frombuffer(r.cells, dtype=np.int32).tolist(), np.frombuffer(r.shares, dtype=np.float32)
        assert cells == (sorted(counts) + [2 << quality.BITS] if len(words) else [])
        assert np.allclose(shares, [counts[c] / len(words) for c in cells[:-1]] + [1.0] if cells else [])


def test_estimate_finds_labeller_accuracy():
    import numpy as np
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.6, 0.75])
    vote = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2
    counts = Counter("".join(map(str, v)) for v in vote.tolist())
    post, chance = quality.estimate(counts)
    assert abs(chance[1, :, 2] - right).max() < 0.05
    assert np.mean([(post["".join(map(str, v))] > 0.5) == t for v, t in zip(vote.tolist(), truth)]) > 0.9


# decontamination

def brute_leaks(rows, items, percent=80):
    def words(t):
        return [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]

    def grams(w, k):
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    out = set()
    for item, text in items:
        b = words(text)
        k = min(5, len(b))
        if not b:
            continue
        want = grams(b, k)
        for doc, t in rows:
            w = words(t)
            if not grams(w, k) & want:
                continue
            for s in range(max(len(w) - len(b), 0) + 1):
                g = grams(w[s:s + len(b)], k)
                if sum((g & want).values()) * 100 >= percent * sum((g | want).values()) and g:
                    out.add((doc, item))
                    break
    return out


def test_leaks_equal_brute_force(docs_of, spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bench += [(900, None), (901, ""), (902, "two words"), (903, "one two three one two three one two three"), (903, bench[0][1]), (None, bench[1][1])]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:60] + hard_rows()
    a = bench[2][1].split()
    rows += [(5000, "start " + " ".join(a[:9] + ["new"] + a[9:]) + " end"), (5001, " ".join(a[:-2])), (5002, " ".join(a[: len(a) // 2])),
             (5003, "has two words here"), (5004, "one two three " * 40), (5005, " ".join(a[:5] + ["x"] + a[6:12] + ["y"] + a[13:])), (None, bench[0][1]),
             (5006, " ".join(a).upper()), (5006, "clean")]
    out = decontaminate.leaks(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == brute_leaks(rows, bench)
    kept = decontaminate.remove_leaks(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert ("clean" in {r.text for r in kept.collect()}) and 5001 not in {r.doc_id for r in kept.collect()}


def test_leaks_empty(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs_of(hard_rows()), none).count() == 0
    assert decontaminate.leaks(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_blocks_hold_every_pair_within_the_radius(spark):
    import random
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 23)):
            y ^= 1 << b
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "a long, b long")
    both = F.arrays_overlap(decontaminate.hamming_blocks(F.col("a")), decontaminate.hamming_blocks(F.col("b")))
    assert df.where(both).count() == 200


def test_words_that_differ_in_case_are_encoded_once():
    """Chunks are known lower-cased; texts with special tokens have the tokenizer's own ids (op4, CPU seconds)."""
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["Word WORD word, wORD. wordy", "a <|endoftext|> B<|ENDOFTEXT|>c Word", "İX ſ K! é ­-x 3,5%", ""]
    own = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    got = encoder.encode([t.encode() for t in texts])
    assert [[int.from_bytes(g[i:i + 4], "little") for i in range(0, len(g), 4)] for g in got] == own
    assert not {b"Word", b"WORD", b"wORD."} & set(encoder.known) and b"word" in encoder.known


def test_windows_are_told_apart_without_their_shingles(spark):
    """Many starts of one document repeat a window: only numbers are grouped, and shingles are cut in the join."""
    starts = spark.createDataFrame([(1, 6, s) for s in (0, 0, 1, 3, 4, 9)] + [(2, 6, 0)], "key long, n_words int, start int")
    body = spark.createDataFrame([(1, list(range(10, 15)), 5), (2, [7, 8], 2)], "key long, grams array<long>, size int")
    out = decontaminate._laid(starts, body, 5)
    assert sorted(map(tuple, out.collect())) == [
        (1, 6, 0, [10, 11]), (1, 6, 1, [11, 12]), (1, 6, 3, [13, 14]), (2, 6, 0, [7, 8])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and not any("grams" in line for line in plan.splitlines() if "Aggregate" in line)


def test_language_model_gives_up_its_caches():
    counts = np.array([[9.0, 1.0], [1.0, 9.0]])
    table = lang_id.Table(["haus", "house"], np.zeros(2), counts, {0: counts.sum(axis=0)})
    model = lang_id.Model(table, lang_id.Table(["a", "e"], np.ones(2), counts, {1: counts.sum(axis=0)}), ["de", "en"])
    first = model.predict(["haus anders", "house"])
    model.forget()
    assert model.row is None and not model.piece_row and model.scores is None
    again = model.predict(["haus anders", "house"])
    assert first[0] == again[0] and list(first[1]) == list(again[1])


def test_plain_words_need_the_merges_only(monkeypatch):
    own, seen = packing.WordEncoder(packing.tokenizer_path()), []
    ids = own._ids
    monkeypatch.setattr(own, "_ids", lambda words: seen.extend(words) or ids(words))
    texts = [f"a{chr(c)}b {chr(c)}, x{chr(c)}." for c in range(0x21, 0x600)] + ["élève Ünï привет, ciónraezos. été..."]
    found = own.encode([t.encode() for t in texts])
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in found] == encode(texts)
    assert not {"élève", "привет", "ciónraezos", "ciónraezos.", "été", "été..."} & set(seen)
