"""Steps of the third review: the work of a query must not grow faster than its input."""

import datetime as dt
import random

from corpuslens.operators import minhash as M
from corpuslens.operators import splits as SP
from corpuslens.operators import subword as SW
from corpuslens.operators import temporal as TM
from corpuslens.plans import corpus as CO
from corpuslens.plans import labels as LB
from test_subwords import greedy, random_words


def test_merges_come_many_to_a_round(spark, monkeypatch):
    """Words that the driver does not hold do not bring the rounds down to one merge each (F1, F3)."""
    words = random_words(5, 400, letters="abcdefghijklmnopqrstuvwxyzçéşı")
    tables = []
    monkeypatch.setattr(SW, "written", lambda df, name, old=SW.written: tables.append(name) or old(df, name))
    got = SW.learn_merges(spark.createDataFrame(list(words.items()), "word string, n long"), 120, contexts=60)
    assert got == greedy(words, 120)[0] and len(tables) <= 12


def test_merges_into_a_symbol_of_another_merge(spark):
    """A symbol made in two ways wins pairs of which the driver holds no count."""
    words = {"abcx": 9, "zabx": 5, "bcq": 8, "abcy": 3, "bcxx": 2, "aabc": 4, "cabcab": 6, "cxab": 7}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for candidates in (1, 3, 50):
        assert SW.learn_merges(table, 14, candidates=candidates, contexts=3) == greedy(words, 14)[0]


def test_phase_volumes_join_days_not_events(spark, monkeypatch):
    """Overlapping phases meet sums of days, each distinct span once (F2)."""
    rnd = random.Random(3)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    events = [(dt.datetime.combine(day(rnd.randint(0, 40)), dt.time(rnd.randint(0, 23))) if i % 50 else None,
               rnd.choice([None, 1.5, 2.0, 7.25])) for i in range(3000)]
    phases = [(p, day(s := rnd.randint(-5, 45)), day(s + rnd.choice([0, 1, 5, 30, -2]))) for p in range(200)] + [(900, day(3), None), (901, None, day(3))]
    want = {}
    for p, s, e in phases:
        held = [v for t, v in events if t and s and e and s <= t.date() < e]
        known = [v for v in held if v is not None]
        if held:
            want[p] = (len(held), round(sum(known) / len(known), 6) if known else None)
    seen = []
    monkeypatch.setattr(TM, "phase_join", lambda e, p, *a, old=TM.phase_join: seen.append((e.count(), p.count())) or old(e, p, *a))
    got = TM.phase_volumes(spark.createDataFrame(events, "ts timestamp, value double"),
                           spark.createDataFrame(phases, "phase long, start date, `end` date"), "ts", "value")
    assert {r.phase: (r.n, r.avg_value and round(r.avg_value, 6)) for r in got.collect()} == want
    assert seen == [(42, len({(s, e) for _, s, e in phases}))]


def test_signatures_and_sets_in_one_pass_of_the_text(spark, monkeypatch):
    """Sets and signatures equal those of exploded shingles, and no text pass of theirs needs a shuffle (F6 to F10)."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(["Ala", "b2", "çok", "x_y", "http://a.b/c", "@me", "!?", "9,5", "　", "\x85", "\t"], k=rnd.randint(0, 60)))
             for _ in range(80)] + [None, "", " ", "one", "a b c d", "a b c d e", "a b c d a b c d a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = M.shingle_rows(df)
    want = {r.id: r.sig for r in M.signatures(rows).collect()}
    got = M.with_signatures(df)
    assert {r.id: r.sig for r in got.collect()} == want
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    sets = M.shingle_sets(df)
    assert {r.id: {h % (1 << 32) for h in r.hashes} for r in sets.collect()} == {
        r.id: set(r.hashes) for r in M.shingle_table(rows).collect()}
    assert {r.id: (r.n, r.sig) for r in M.set_signatures(sets).collect()} == {
        r.id: (len(set(r.hashes)), want[r.id]) for r in M.shingle_table(rows).collect()}


def test_candidate_pairs_read_the_text_once(spark, monkeypatch):
    """The bucket minima, the large buckets and their join read written bands (F8, F9)."""
    passes = []
    monkeypatch.setattr(CO.W, "written", lambda df, name, old=CO.W.written: passes.append(name) or old(df, name))
    plan = CO.lsh_candidate_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert passes == ["bands"] and "documents.parquet" not in plan


def test_leakage_reads_each_text_once(spark, monkeypatch):
    """The split takes the signatures that were made with the sets, and equal sets are found by their digests (F6)."""
    passes = []
    for name in ("with_signatures", "shingle_sets"):
        monkeypatch.setattr(M, name, lambda *a, old=getattr(M, name), name=name, **k: passes.append(name) or old(*a, **k))
    LB.leakage_rows(spark, "/root/testdata/sf0.001")
    assert passes == ["shingle_sets"]
    passes.clear()
    LB.leakage_audit(spark, "/root/testdata/sf0.001")
    assert passes == ["with_signatures"]
    rows = [(i, f"{'same ' * (i % 3)}text number {i // 6}", i % 2) for i in range(60)] + [(60, None, 0), (61, "", 0), (62, " ", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_synth int")
    sets = M.shingle_sets(df, keep=("is_synth",))
    assert sorted(M.set_classes(sets).collect()) == sorted(M.set_classes(sets.select("id", "hashes")).collect())
    plain = SP.split_groups(df, test=0.01, val=0.01).select("doc_id", "root", "split")
    shared = SP.split_groups(df, test=0.01, val=0.01, signatures=sets.where("is_synth = 0")).select("doc_id", "root", "split")
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.collect()))


def test_first_merges_in_one_job(spark, monkeypatch):
    """A few merges that the frequent words foretell need one job over the words, not one for every eight (F5)."""
    words = random_words(5, 400, letters="abcdefghijklmnopqrstuvwxyzçéşı")
    jobs = []
    monkeypatch.setattr(SW, "_changes", lambda *a, old=SW._changes: jobs.append(len(a[2])) or old(*a))
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert SW.learn_merges(table, 25) == greedy(words, 25)[0] and jobs == [25]
    assert SW.alphabet_of(table) == sorted({SW.BOUNDARY, *"".join(words)})
    assert SW.alphabet_of(table.limit(0)) == []
