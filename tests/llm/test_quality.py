"""The quality classifier's votes, label model and scores against plain re-statements."""

import math
import string
from collections import Counter

import numpy as np

from corpuslens.llm import quality
from corpuslens.llm.tokens import U64, mix, numbers, word_hashes

from .conftest import SMALL, hard_rows

MARKS = set(string.punctuation.encode())


def plain_votes(text):
    """Every labeller's rule, word by word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * 12 + [-1]

    def vote(value, good, bad):
        return 1 if good(value) else -1 if bad(value) else 0

    share = lambda hits, of: hits / of if of else 0.0
    upper = sum(65 <= b <= 90 for b in raw)
    lower = sum(97 <= b <= 122 for b in raw) + sum(b >= 128 for b in raw) // 2
    odd = set(b"#$%&*|~^<>{}[]=\\!")
    runs = sum(b in odd and (i == 0 or raw[i - 1] not in odd) for i, b in enumerate(raw))
    stops = sum(b in b".?!" for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        vote(share(sum(a == b for a, b in zip(words, words[1:])), n - 1), lambda v: v < 0.05, lambda v: v > 0.15),
        vote(share(sum(a == b for a, b in zip(words, words[2:])), n - 2), lambda v: v < 0.05, lambda v: v > 0.2),
        vote(sum(b in b"#$%&*|~^<>{}[]=\\_@" for b in raw) / len(raw), lambda v: v < 0.005, lambda v: v > 0.02),
        vote(sum(len(w) > 1 and w[-1] == w[-2] and w[-1] in MARKS for w in words) / n, lambda v: v < 0.02, lambda v: v > 0.2),
        vote(runs / n, lambda v: v < 0.05, lambda v: v > 0.2),
        vote(sum(all(b in MARKS or 48 <= b <= 57 for b in w) for w in words) / n, lambda v: v < 0.1, lambda v: v > 0.2),
        vote(upper / max(upper + lower, 1), lambda v: v < 0.2, lambda v: v > 0.5),
        vote(raw.count(b"!") / n, lambda v: v < 0.1, lambda v: v > 0.3),
        vote(len(set(words)) / min(n, 200), lambda v: v > 0.4, lambda v: v < 0.2) if n >= 30 else 0,
        vote(stops / n, lambda v: 0.01 <= v <= 0.4, lambda v: v < 0.003 or v > 0.6) if n >= 30 else 0,
        vote(len(raw) / n, lambda v: 3 <= v <= 14, lambda v: v < 2.5 or v > 25),
        vote(len(set(lines)) / len(lines), lambda v: v > 0.8, lambda v: v < 0.5) if len(lines) >= 4 else 0,
        1 if n >= 20 else -1 if n < 3 else 0,
    ]


def plain_posteriors(patterns):
    """Expectation-maximisation with loops over patterns, classes and labellers."""
    post = {}
    for p in patterns:
        good, bad = p.count("2"), p.count("0")
        post[p] = 0.5 * good / max(good + 3 * bad, 1) if bad else 0.95
    for _ in range(200):
        size = [sum(n * (1 - post[p]) for p, n in patterns.items()), sum(n * post[p] for p, n in patterns.items())]
        chance = {}
        for c in (0, 1):
            for at in range(len(quality.LABELLERS)):
                votes = {v: 1.0 + sum(n * (post[p] if c else 1 - post[p]) for p, n in patterns.items() if p[at] == v) for v in "02"}
                for v in "02":
                    chance[c, at, v] = votes[v] / sum(votes.values())
        moved = 0.0
        for p in patterns:
            logs = [math.log((size[c] + 1) / (sum(size) + 2)) + sum(math.log(chance[c, at, v]) for at, v in enumerate(p) if v != "1")
                    for c in (0, 1)]
            fresh = 1 / (1 + math.exp(min(max(logs[0] - logs[1], -50), 50)))
            moved = max(moved, abs(fresh - post[p]))
            chance["next", p] = fresh
        post = {p: chance["next", p] for p in patterns}
        if moved < 1e-9:
            break
    return post


def plain_score(weights, text):
    """Mean weight of a text's words and shapes, each hashed by itself."""
    words = (text or "").encode().split()
    if not words:
        return 0.0
    total, last = 0.0, None
    for w in words:
        one = word_hashes([w])[0][0]
        shape = word_hashes([w.translate(quality._SHAPE)])[0][0]
        shape = mix(np.array([shape * numbers(31, 1)[0] + U64(w == last)], dtype=U64))[0]
        mask = U64((1 << quality.BITS) - 1)
        total += weights[int(one & mask)] + weights[(1 << quality.BITS) + int(shape & mask)]
        last = w
    return 1 / (1 + math.exp(-min(max(total / len(words) + weights[-1], -30), 30)))


def test_votes_and_label_model_equal_plain_rules(spark, docs_of):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = table + hard_rows() + [(7000, "!!! ??? --- 12 $5 a__ b.."), (7001, "x\n" * 40), (7002, "A B\tC!! " * 30)]
    docs = docs_of(rows)
    found = Counter(r.pattern for r in quality.vote_table(docs.selectExpr("doc_id AS key", "text")).collect())
    want = Counter("".join(str(v + 1) for v in plain_votes(t)) for _, t in rows)
    assert found == want
    post, _ = quality.estimate(dict(want))
    plain = plain_posteriors(dict(want))
    assert max(abs(post[p] - plain[p]) for p in want) < 1e-6


def test_scores_equal_word_by_word_sums():
    weights = np.random.default_rng(2).normal(size=(2 << quality.BITS) + 1)
    texts = [t for _, t in hard_rows() if t is None or len(t) < 3000] + ["Aa aa aa AA 12 12 34 it's", "é É ñ!!"]
    got = quality._scores(weights, [(t or "").encode() for t in texts])
    assert np.allclose(got, [plain_score(weights, t) for t in texts], atol=1e-9)
