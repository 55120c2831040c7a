"""Byte-pair merges in exact greedy order, and encoding, against plain re-statements."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.operators import subword as SW


def greedy(words, most):
    """One merge at a time: the most frequent pair, of equal ones the smallest, over all words."""
    state = {w: ["▁", *w] for w in words}
    made, merges = set(), []
    while len(made) < most:
        seen = Counter()
        for w, sym in state.items():
            for pair in zip(sym, sym[1:]):
                seen[pair] += words[w]
        if not seen:
            break
        (a, b), n = min(seen.items(), key=lambda x: (-x[1], x[0]))
        merges.append((a, b, n))
        made |= {a + b} - {c for w in words for c in "▁" + w}
        state = {w: _plain_apply(sym, a, b) for w, sym in state.items()}
    return merges, state


def _plain_apply(sym, a, b):
    out, i = [], 0
    while i < len(sym):
        if sym[i:i + 2] == [a, b]:
            out.append(a + b)
            i += 2
        else:
            out.append(sym[i])
            i += 1
    return out


def random_words(seed, n, letters="abcdeé"):
    rnd = random.Random(seed)
    return {"".join(rnd.choices(letters, range(len(letters), 0, -1), k=rnd.randint(1, 9))): rnd.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize("options", [{}, {"candidates": 7, "around": 1}, {"candidates": 40, "contexts": 25, "around": 2}])
def test_merges_equal_one_at_a_time(spark, options):
    words = random_words(8, 250)
    want, _ = greedy(words, 200)
    got = SW.learn_merges(spark.createDataFrame(list(words.items()), "word string, n long"), 200 if not options else 60, **options)
    assert got == want[:len(got)] and len(got) >= (200 if not options else 60)


def test_merges_until_no_pair_is_left(spark):
    one = spark.createDataFrame([("abc", 2)], "word string, n long")
    assert SW.learn_merges(one, 50) == greedy({"abc": 2}, 50)[0] and len(SW.learn_merges(one, 50)) == 3
    assert SW.learn_merges(one.limit(0), 5) == []
    run = {"aaaa": 5, "aaaaa": 3, "baaab": 2}
    assert SW.learn_merges(spark.createDataFrame(list(run.items()), "word string, n long"), 50) == greedy(run, 50)[0]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=8), st.integers(1, 5), min_size=1, max_size=25),
       st.integers(1, 12), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_rounds_on_pieces_equal_one_at_a_time(words, candidates, around):
    """The driver's part alone: rounds of pieces give the greedy order whatever is cut."""
    state = {w: ["▁", *w] for w in words}
    there = {s for sym in state.values() for s in sym}
    alphabet, got = len(there), []
    while len(there) - alphabet < 30:
        seen = Counter()
        for w, sym in state.items():
            for pair in zip(sym, sym[1:]):
                seen[pair] += words[w]
        ranked = sorted((-n, a, b) for (a, b), n in seen.items())
        if not ranked:
            break
        wanted = {(a, b): -n for n, a, b in ranked[:candidates]}
        found = Counter()
        for w, sym in state.items():
            for piece, left, right in SW.pieces(sym, set(wanted), around):
                found[tuple(piece), left, right] += words[w]
        more = SW.merge_round([(list(p), x, y, n) for (p, x, y), n in found.items()], wanted,
                              ranked[candidates] if len(ranked) > candidates else None, there, 30 - (len(there) - alphabet))
        assert more
        ranks = {}
        for i, (a, b, _) in enumerate(more):
            ranks.setdefault((a, b), i)
        state = {w: SW.replay(sym, ranks) for w, sym in state.items()}
        got += more
        there |= {a + b for a, b, _ in more}
    assert got == greedy(words, 30)[0]


def test_encoding_equals_merging_by_rank(spark, monkeypatch):
    words = random_words(3, 120)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    merges = SW.learn_merges(table, 80)
    vocab = SW.vocabulary(table, merges)
    ranks = {(a, b): i for i, (a, b, _) in reversed(list(enumerate(merges)))}
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(list(words) + ["zzz", "aZb"], k=rnd.randint(0, 40))) for _ in range(60)] + [None, "", "  ", "a\n b\tc"]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)]
    want = sorted([(i, [vocab.index(s) if s in vocab else 1 for w in (t or "").split() for s in SW.merge_word(["▁", *w], ranks)])
                   for i, t in rows], key=repr)
    df = spark.createDataFrame(rows, "id int, text string").withColumns({c: F.lit("x") for c in ("word", "ids", "_row", "n")})
    for small, hot in ((SW.SMALL_WORDS, SW.HOT_WORD), (0, 5)):
        monkeypatch.setattr(SW, "SMALL_WORDS", small)
        monkeypatch.setattr(SW, "HOT_WORD", hot)
        got = SW.encode(df, "text", ["id", "word"], merges, vocab)
        assert sorted([(r.id, r.ids) for r in got.collect()], key=repr) == want
        cut = SW.encode(df, "text", ["id"], merges, vocab, maxlen=5)
        assert sorted([(r.id, r.ids) for r in cut.collect()], key=repr) == sorted(
            [(i, (x + [0] * 5)[:5]) for i, x in want], key=repr)
