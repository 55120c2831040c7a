"""Mixing, conversation repair and ranked search against plain re-statements."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.llm import conversation, mixing, ranked_search
from tests.llm.conftest import SMALL, hard_rows

# ---------------------------------------------------------------- conversation repair


def cheapest(kinds):
    """(cost, edits) of whole conversations by plain dynamic programming over (cost, string) pairs."""
    free = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserted(at):
        for _ in range(3):
            for q in list(at):
                c, s = at[q]
                at[free[q]] = min(at.get(free[q], (math.inf, "")), (c + 3, s + "I"))
        return at

    now = inserted({0: (0, "")})
    for k in kinds:
        then = {}

        def offer(q, c, s, then=then):
            then[q] = min(then.get(q, (math.inf, "")), (c, s))

        for q, (c, s) in now.items():
            offer(q, c + 4, s + "D")
            if k != "d":
                more = 3 * k.isupper()
                offer(free[q], c + 3 + more, s + "R")
                if (k.lower(), q) in keep:
                    offer(keep[k.lower(), q], c + more, s + "K")
        now = inserted(then)
    return min(now[q] for q in (0, 3) if q in now)


def restated(rows):
    """The contract's columns from (conv_id, turn, role, text) rows."""
    blank = lambda v: " " if v is None else str(v)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own.extend([(turn, role, text)] * (1 + (kind == 3)))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, kinds, n = set(), "", Counter()
        for _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not words else "duplicate" if (role, text) in seen
                     else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
            n[fault] += 1
            letter = role[0] if role[:1] in ("s", "u", "a") else "x"
            kinds += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(kinds)
        lines, todo, roles = [], iter(own), ""
        for letter in audit:
            row = next(todo) if letter != "I" else None
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in conversation.repair_damaged(df).collect()}


@given(st.text("suaxSUAXd", max_size=14))
@settings(max_examples=300, deadline=None)
def test_auction_equals_dynamic_programming(kinds):
    cost, _, letters = conversation.edits(kinds, conversation.ACCEPTED, True)
    assert (cost[0], letters[0]) == cheapest(kinds)


@given(st.text("suaxSUAXd", max_size=10), st.lists(st.sampled_from([None, 0, 1, 2, 5, 9]), min_size=4, max_size=4))
@settings(max_examples=100, deadline=None)
def test_prices_are_feasible_and_the_paths_tight(kinds, ends):
    arcs = conversation.lattice(kinds, tuple(ends), False)
    price = [0] * len(arcs)
    found = [conversation.auction(arcs, q, price) for q in range(4)]
    assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for _, j, c in out)
    best = [0] * len(arcs)  # shortest distances by relaxation
    best[:-1] = [math.inf] * (len(arcs) - 1)
    for _ in arcs:
        for i, out in enumerate(arcs):
            for _, j, c in out:
                best[i] = min(best[i], c + best[j])
    assert found == [None if best[q] == math.inf else best[q] for q in range(4)]


def test_repair_of_the_whole_table_equals_the_restatement(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert repaired(table) == restated(rows)


def test_repair_of_odd_rows_and_of_conversations_longer_than_a_segment(spark):
    rng = np.random.default_rng(5)
    rows = [(None, 1, "user", "A."), (None, None, None, None), (1, None, "user", "x"), (1, None, "assistant", "y."),
            (2, 5, "", "role without a letter."), (2, 9, "tool", "t."), (3, 1, "user", " \n\t"), (4, 1, "user", "u?"),
            (4, 1, "user", "u?"), (4, 2, "assistant", "w" * 200_000 + "!"), (5, -3, "system", "s."), (5, 2, "user", "u \n")]
    for conv, size in ((10, 33), (11, 200), (12, 64)):
        for t in range(size):
            role = ["user", "assistant", "system", "other"][rng.choice(4, p=[0.45, 0.45, 0.05, 0.05])]
            rows.append((conv, int(t // 1.3), role, f"{rng.integers(0, 40)}" + rng.choice([".", "!", "", " "])))
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)) == restated(rows)


def test_conversations_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repaired(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}


def test_repair_ignores_columns_of_clashing_names(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(8)]
    plain = spark.createDataFrame(rows, SCHEMA)
    more = plain.withColumns({c: F.lit(1) for c in ("key", "idx", "seg", "kind", "fault", "cost", "audit", "_copy", "_kind")})
    assert repaired(more) == repaired(plain) == restated(rows)


# ---------------------------------------------------------------- mixing


def mixed(df, **options):
    return [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df, **options).collect()]


def watered(sizes):
    """Targets by the contract's words: share by weight, stop at three times, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        heavy = sum(w for s, w in weight.items() if s not in stopped)
        level = {s: weight[s] * left / heavy for s in names if s not in stopped}
        more = {s for s, t in level.items() if t > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in stopped else level[s] for s in names}
        stopped |= more


def check_mix(rows, found):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = watered(size) if rows else {}
    taken = Counter()
    for _, source, n, of_source, aim, took in found:
        assert of_source == size[source] and aim == pytest.approx(target[source])
        assert 0 <= took <= 3 * n
        taken[source] += took
    assert sorted(map(repr, [f[0] for f in found])) == sorted(map(repr, [r[0] for r in rows]))
    parties = len([s for s in size if size[s]])
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK * (1 + parties / 20) for s in size)
    return taken, target


def test_mix_of_the_whole_table_hits_its_targets_and_reruns_agree(spark, small_docs):
    rows = [(r.doc_id, r.text, r.source) for r in small_docs.collect()]
    found = mixed(small_docs)
    check_mix(rows, found)
    assert sorted(found) == sorted(mixed(small_docs.repartition(7)))


def test_mix_with_a_hot_source_a_stopped_source_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "b") for i in range(400)]
    rows += [(1000 + i, "one two three", "a") for i in range(50)]  # stops at three times its 150 words
    rows += [(2000 + i, "x " * 200, None) for i in range(30)] + [(3000, "y " * 20_000, "c"), (3001, None, "c"), (3002, "", "")]
    rows += [(None, "z " * 500, "d"), (None, None, "d"), (7, "same id", "d"), (7, "same id", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, target = check_mix(rows, mixed(df))
    assert target["a"] == 450 and abs(taken["a"] - 450) <= mixing.BLOCK
    more = df.withColumns({c: F.lit(1) for c in ("id", "size", "name", "shard", "digest", "votes", "target", "_at", "_q")})
    assert sorted(map(repr, mixed(more))) == sorted(map(repr, mixed(df)))


def test_mix_of_tables_without_words(spark):
    schema = "doc_id long, text string, source string"
    assert mixed(spark.createDataFrame([], schema)) == []
    assert mixed(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)) == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(0, 70))
@settings(max_examples=6, deadline=None)
def test_apportion_gives_the_highest_quotients(spark, votes, seats):
    rows = [(g, p, v, seats) for g in (0, 1) for p, v in enumerate(votes)]
    found = mixing.apportion(spark.createDataFrame(rows, "g int, p int, votes long, seats_of_group long"), "g", "p")
    got = {(r.g, r.p): r.seats for r in found.collect()}
    top = sorted(((v / (2 * k + 1), -p) for p, v in enumerate(votes) if v for k in range(seats)), reverse=True)[:seats]
    want = Counter(-p for _, p in top)
    assert got == {(g, p): want[p] for g in (0, 1) for p in range(len(votes))}


# ---------------------------------------------------------------- ranked search


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """{item: [(doc_id, score)]} by scoring every document for every item."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, n_docs = sum(n for _, _, n in counts), len(counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(plain_terms(text))
    out = {}
    for item, own in wanted.items():
        scores = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        if scores:
            out[item] = [(None if null else d, -s) for s, null, d in sorted(scores)[:k]]
    return out


def searched(df, items, **options):
    out = defaultdict(dict)
    for r in ranked_search.search(df, items, **options).collect():
        assert r["rank"] not in out[r.item_id]
        out[r.item_id][r["rank"]] = (r.doc_id, r.score)
    return {i: [ranks[n + 1] for n in range(len(ranks))] for i, ranks in out.items()}


@pytest.mark.parametrize("options", [{}, {"shard": 1500, "pairs": 300}])
def test_search_of_the_whole_table_equals_scoring_everything(spark, small_docs, options):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs, wanted = [(r.doc_id, r.text) for r in small_docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert searched(small_docs, items, **options) == ranked(docs, wanted)


def test_search_with_odd_rows_and_ties(spark, docs_of):
    docs = hard_rows() + [(100 + i, "tie tie common") for i in range(25)] + [(200, "Größe über"), (201, "a_b-c42")]
    items = [(1, "TIE word"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (5, "Größe b c42 w0x0 same"), (None, "common"),
             (6, "tie"), (6, "w1x1"), (7, " ".join(f"long{i}" for i in range(5000)))]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert searched(docs_of(docs), table) == ranked(docs, items)
    more = docs_of(docs).withColumns({c: F.lit(1) for c in ("id", "n", "terms", "tfs", "shard", "item", "rank", "score")})
    assert searched(more, table.withColumn("item", F.lit(1))) == ranked(docs, items)
    assert searched(docs_of([]), table) == {} == searched(docs_of(docs), table.limit(0))


def test_best_positions_stop_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    n = 5000
    doc, term, impact = [], [], []
    for t in range(4):
        doc.append(np.arange(n))
        term.append(np.full(n, t))
        impact.append(np.sort(rng.integers(1, 1000, n))[::-1] + np.where(np.arange(n) < 20, 2000, 0))
    shard = ranked_search.Shard(*map(np.concatenate, (doc, term, impact)), np.arange(n))
    docs, score, scored = shard.best(np.arange(4), 4, 10)
    total = np.sum(impact, axis=0)
    order = np.lexsort((np.arange(n), -total))[:10]
    assert docs.tolist() == order.tolist() and score.tolist() == total[order].tolist()
    assert scored < n // 10
