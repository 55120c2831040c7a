"""Steps of the fourth review: whole spans, and links verified without moving sets pair by pair."""

import datetime as dt
import hashlib
import itertools
import random

import numpy as np

from corpuslens.functions import overlap as OV
from corpuslens.operators import minhash as M
from corpuslens.plans import registry


def test_phases_span_all_events_of_a_user(spark, tmp_path):
    """A user's span comes from all their events, whatever the ids of these (F2)."""
    rnd = random.Random(4)
    at = lambda i: dt.datetime(2024, 1, 1, rnd.randint(0, 23)) + dt.timedelta(days=i)
    rows = [(i, at(rnd.randint(0, 20)) if i % 41 else None, rnd.choice([1, 2, 3, None]), rnd.choice([None, 0.5, 4.0]))
            for i in range(300)]
    rows += [(7 * i + 1, at(25 + i), 8, 1.0) for i in range(6)]  # a user without an id that 7 divides
    rows += [(7, at(10), 9, 2.0), (8, at(2), 9, 2.0), (13, at(30), 9, 2.0), (701, None, 10, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    days = [(u, t.date(), v) for _, t, u, v in rows if t]
    want = {}
    for user in {u for u, _, _ in days}:
        own = [d for u, d, _ in days if u == user]
        held = [v for _, d, v in days if min(own) <= d <= max(own)]
        known = [v for v in held if v is not None]
        want[user] = (len(held), round(sum(known) / len(known), 6))
    got = registry.all_queries()["phase_overlaps"](spark, str(tmp_path))
    assert {r.phase: (r.n, r.avg_value) for r in got.collect()} == want


def test_text_sets_and_minima_equal_plain_ones():
    """Shingles of all lengths around a block of MD5, and remainders at both ends of their range (F1)."""
    rnd = random.Random(6)
    texts = [None, "", " ", "a", " a  b ", "a b c d", "a b c d e", "a a a a a a", "x" * 55, "x" * 56, "ç" * 28, "ü b " * 40]
    texts += [" ".join("wşx"[rnd.randrange(3)] * rnd.randint(1, 25) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    for k in (1, 2, 4):
        for text, got in zip(texts, M.text_sets(texts, k), strict=True):
            words = (text or "").split()
            plain = {" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))}
            assert got.tolist() == sorted({int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in plain})
    perms = M.permutations()
    ends = [h for a, b in perms for r in (0, 1, M.PRIME - 1) if (h := (r - b) * pow(a, -1, M.PRIME) % M.PRIME) < 2 ** 32]
    for hashes in [[h] for h in ends] + [rnd.sample(range(2 ** 32), 700), [0], [2 ** 32 - 1]]:
        got = M.minima(np.array(hashes, np.uint32), *M._columns(len(perms)))
        assert got.tolist() == [min((a * h + b) % M.PRIME for h in hashes) for a, b in perms]


def test_intersections_equal_sets(monkeypatch):
    monkeypatch.setattr(OV, "COLUMNS", 128)
    monkeypatch.setattr(OV, "PAIRS", 7)
    rnd = random.Random(7)
    sets = [rnd.sample(range(-500, 500), rnd.choice([0, 1, 5, 300])) for _ in range(40)]
    at = np.append(0, np.cumsum([len(x) for x in sets]))
    pairs = [(a, b, 1) for a, b in itertools.combinations(range(25), 2)] + [(a, a + 1, a) for a in range(25, 39)]
    rnd.shuffle(pairs)
    a, b, group = np.array(pairs).T
    got = OV.intersections(np.concatenate([np.array(x, np.int64) for x in sets]), at, a, b, group)
    assert got.tolist() == [len(set(sets[x]) & set(sets[y])) for x, y, _ in pairs]


def test_sets_move_by_home_not_by_pair(spark, monkeypatch):
    """All links of a group of near copies, from sets that move a few times each and pairs that are formed once (F1)."""
    rnd = random.Random(8)
    word = lambda first, i: first + "".join(chr(97 + int(c)) for c in str(i))
    base = [word("w", i) for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 4)):
            words[at] = word("v", rnd.randrange(10 ** 6))
        rows.append((i, " ".join(words)))
    rows += [(200 + i, f"lone text {word('x', i)} of its own words {word('y', i * 7)}") for i in range(9)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = {}
    keep = lambda df, name, old=M.written: tables.setdefault(name, old(df, name))
    monkeypatch.setattr(M, "written", keep)
    sets = M.shingle_sets(docs).cache()
    held = {r.id: set(r.hashes) for r in sets.collect()}
    for rows_of_a_block in (256, 20):
        monkeypatch.setattr(M, "BLOCK_ROWS", rows_of_a_block)
        tables.clear()
        own, buckets = M.class_buckets(sets, M.set_classes(sets).localCheckpoint())
        pairs = M.bucket_pairs(buckets).localCheckpoint()
        found = [(r.src, r.dst) for r in pairs.collect()]
        reps = {r.id for r in own.collect()}
        want = {(b, a): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in itertools.combinations(sorted(reps), 2)}
        want = {p: j for p, j in want.items() if j >= M.DEFAULT_THRESHOLD}
        got = {(r.src, r.dst): r.jaccard for r in M.verify_edges(pairs, own).collect()}
        assert len(found) == len(set(found)) and got == want and len(want) > 1000
        blocks = -(-len(reps) // rows_of_a_block) + 1
        assert tables["ends"].count() <= len(reps) * M.RECALL_BANDS * blocks
        assert tables["members"].count() <= len(reps) * M.RECALL_BANDS
