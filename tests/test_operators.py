import random

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.operators import components as C
from corpuslens.operators import dedupe as D
from corpuslens.operators import evaluate as E
from corpuslens.operators import temporal as TM
from corpuslens.operators.ranking import row_index
from corpuslens.operators.subword import apply_merge
from corpuslens.sources.schemas import MissingColumnsError, require_columns


def test_dedupe_keeps_first_and_is_idempotent(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "b")]
    df = spark.createDataFrame(rows, "seq long, text string")
    once = D.dedupe_exact_first(df, "text", "seq")
    assert sorted(r.seq for r in once.collect()) == [1, 2, 4]
    twice = D.dedupe_exact_first(once, "text", "seq")
    assert sorted(r.seq for r in twice.collect()) == [1, 2, 4]
    rep = D.dedupe_report(df).first()
    assert (rep.rows_before, rep.rows_removed, rep.rows_after) == (6, 3, 3)


def test_row_index_matches_sorted_order_any_partitioning(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice(["x", "y", "z"]), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string, v double")
    expect = {}
    for g in "xyz":
        for k, r in enumerate(sorted([d for d in data if d[1] == g], key=lambda d: (d[2], d[0]))):
            expect[r[0]] = k + 1
    for parts in (1, 4, 17):
        got = row_index(df.repartition(parts), ["v", "id"], group_cols=["g"], num_partitions=parts)
        assert {r.id: r.rn for r in got.collect()} == expect


def test_components_equal_bfs(spark):
    rnd = random.Random(3)
    n = 200
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(150)]
    v = spark.range(n).select(F.col("id"))
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.root for r in C.connected_components(v, e).collect()}
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    seen, expect = set(), {}
    for s in range(n):
        if s in seen:
            continue
        comp, stack = [], [s]
        seen.add(s)
        while stack:
            x = stack.pop()
            comp.append(x)
            for y in adj[x] - seen:
                seen.add(y)
                stack.append(y)
        for x in comp:
            expect[x] = min(comp)
    assert got == expect


def test_threshold_sweep_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([0.0, 0.005, 0.1, 0.5, 0.995, 1.0, rnd.random()]), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = {r.k: (r.tp, r.fp, r.fn, r.tn) for r in E.threshold_sweep(df, "p", "y", 0.0, 0.005, 200).collect()}
    for k in range(200):
        t = k * 0.005
        tp = sum(1 for p, y in rows if y == 1 and p >= t)
        fp = sum(1 for p, y in rows if y == 0 and p >= t)
        fn = sum(1 for p, y in rows if y == 1 and p < t)
        tn = sum(1 for p, y in rows if y == 0 and p < t)
        assert got[k] == (tp, fp, fn, tn), k


def test_best_threshold_tie_goes_to_lowest(spark):
    sweep = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.005, 0.9), (2, 0.01, 0.9)], "k long, threshold double, macro_f1 double")
    assert E.best_threshold(sweep).first().threshold == 0.005


def test_nearest_join_brute_force(spark):
    rnd = random.Random(5)
    base = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(300):
        rows.append((i, rnd.randint(0, 4), (base + pd.Timedelta(minutes=rnd.randint(0, 4 * 1440))).to_pydatetime(),
                     rnd.choice(["L", "R"])))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp, side string")
    got = {r.left_id: r.right_id for r in TM.nearest_join(df.where("side = 'L'"), df.where("side = 'R'"),
                                                          "k", "ts", "id").collect()}
    for i, k, ts, side in rows:
        if side != "L":
            continue
        cands = [(abs((ts - t2).total_seconds()), t2, j) for j, k2, t2, s2 in rows if s2 == "R" and k2 == k]
        assert got[i] == (min(cands)[2] if cands else None)


def test_apply_merge_left_to_right(spark):
    df = spark.createDataFrame([(["a", "a", "a"],), (["a", "b", "b"],)], "s array<string>")
    out = [r.o for r in df.select(apply_merge(F.col("s"), "a", "a").alias("o")).collect()]
    assert out[0] == ["aa", "a"]
    out = [r.o for r in df.select(apply_merge(F.col("s"), "a", "b").alias("o")).collect()]
    assert out[1] == ["ab", "b"]


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "text long")
    try:
        require_columns(df, {"text", "label"})
    except MissingColumnsError as e:
        assert "label" in str(e)
    else:
        raise AssertionError("expected failure")


def test_running_sum_any_partitioning(spark):
    from corpuslens.operators.ranking import running_sum
    rnd = random.Random(2)
    data = [(i, rnd.random(), rnd.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, h double, size long")
    acc, expect = 0, {}
    for i, h, s in sorted(data, key=lambda d: (d[1], d[0])):
        acc += s
        expect[i] = acc
    for parts in (1, 3, 17):
        got = running_sum(df.repartition(parts), ["h", "id"], "size", num_partitions=parts)
        assert {r.id: r.cum for r in got.collect()} == expect


def test_empty_relation_keeps_schema(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string").limit(0)
    assert df.count() == 0 and df.columns == ["id", "text"]


def test_sessionize_equals_brute_force(spark):
    """A gap of at least 30 minutes starts a new session (Spark's session_window would also merge
    sessions that touch exactly at the gap; the SQL oracle uses the same rule as here)."""
    from collections import defaultdict

    from corpuslens.operators.temporal import sessionize
    rnd = random.Random(9)
    base = pd.Timestamp("2024-01-01 22:00")
    rows = [(rnd.choice(["a", "b"]), (base + pd.Timedelta(minutes=rnd.randint(0, 3000))).to_pydatetime())
            for _ in range(400)]
    df = spark.createDataFrame(rows, "u string, ts timestamp")
    got = {(r.u, r.session_start, r.session_end, r.n) for r in sessionize(df, "u", "ts", 1800).collect()}
    by = defaultdict(list)
    for u, t in rows:
        by[u].append(t)
    exp = set()
    for u, ts in by.items():
        ts.sort()
        start, last, n = ts[0], ts[0], 1
        for t in ts[1:]:
            if (t - last).total_seconds() >= 1800:
                exp.add((u, start, last + pd.Timedelta(minutes=30), n))
                start, n = t, 0
            last = t
            n += 1
        exp.add((u, start, last + pd.Timedelta(minutes=30), n))
    assert got == exp


def test_tag_join_phrases_and_unigrams(spark):
    from corpuslens.operators import keywords as K
    df = spark.createDataFrame([(1, "Bugün öğrenci işleri yine rezalet, iyi ki Bilkent var"),
                                (2, "öğrenci"), (3, "iyi ki"), (4, None)], "id long, text string")
    got = {(r.id, r.kind, r.code, r.n_hits) for r in K.tag_join(df, "id", "text", K.catalog_df(spark)).collect()}
    assert got == {(1, "topic", "idari", 1), (1, "topic", "guclu_negatif", 1), (1, "topic", "guclu_pozitif", 1),
                   (1, "institution", "BILKENT", 1), (3, "topic", "guclu_pozitif", 1)}


def test_vocabulary_character_coverage(spark):
    from corpuslens.operators.subword import vocabulary
    words = spark.createDataFrame([("aaab", 10), ("c", 1)], "word string, n long")
    full = vocabulary(words, [])
    assert full[:2] == ["<pad>", "<unk>"] and set(full[2:]) == {"▁", "a", "b", "c"}
    # a: 30 of 52 occurrences, ▁: 11, b: 10, c: 1 -> 0.7 coverage keeps a and the boundary
    assert set(vocabulary(words, [], character_coverage=0.7)[2:]) == {"▁", "a"}


def test_registered_vocabulary_size():
    from corpuslens.plans import subwords
    assert subwords.VOCAB_SIZE == 8_000


def test_hop_to_the_root_of_a_giant_component_is_even(spark):
    """A component with a third of all vertices: its root is looked up from many tasks, alike."""
    labels = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("root"))
    jumps = labels.select(F.col("id").alias("root"), F.col("root").alias("root2"))
    hop = C.hop_over(labels, jumps, 100, 16)
    assert {r.id: r.root2 for r in hop.collect()} == {i: 0 if i < 1000 else i for i in range(3000)}
    sizes = hop.groupBy(F.when(F.col("root") == 0, F.pmod("id", F.lit(16))).alias("k")).count().where("k is not null").collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) <= 63
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 900)] + [(1000 + i, 1001 + i) for i in range(20)], "src long, dst long")
    v = spark.range(1200).select("id")
    got = {r.id: r.root for r in C.connected_components(v, edges, hot_rows=50, salts=8).collect()}
    assert got == {i: 0 if i < 900 else 1000 if 1000 <= i <= 1020 else i for i in range(1200)}


def test_phase_join_equals_a_range_join(spark):
    import datetime as dt
    rnd = random.Random(9)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(-400, 6000))) for i in range(400)] + [(900, None)]
    phases = [(p, day(s := rnd.randint(-30, 250)), day(s + rnd.choice([0, 1, 5, 40, 300, -3]))) for p in range(150)] + [(999, day(0), None)]
    e = spark.createDataFrame(events, "id long, ts timestamp")
    p = spark.createDataFrame(phases, "phase long, start date, `end` date")
    want = sorted((i, q) for i, t in events for q, s, x in phases if t and x and s <= t.date() < x)
    for options in ({}, {"cell_days": 1, "hot_rows": 3}, {"cell_days": 1000, "hot_rows": 50}):
        out = TM.phase_join(e, p, "ts", **options)
        assert out.columns == ["id", "ts", "phase"] and sorted((r.id, r.phase) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert len(want) > 1000


def test_nearest_join_of_a_hot_key_spreads_over_ranges(spark):
    """One key holds most rows, all within one hour and many at one instant."""
    rnd = random.Random(12)
    rows = [(i, 1 if i % 3 else rnd.randint(0, 5), 1_700_000_000 + rnd.choice([0, 0, rnd.randint(0, 3599)]), rnd.choice("LR")) for i in range(900)]
    rows += [(2000, None, 1_700_000_000, "L"), (2001, 1, None, "L"), (2002, 1, None, "R"), (2003, 77, 1_700_000_000, "L")]
    df = spark.createDataFrame(rows, "id long, k long, s long, side string").withColumn("ts", F.timestamp_seconds("s"))
    left, right = df.where("side = 'L'"), df.where("side = 'R'")
    for n in (1, 16):
        out = {r.left_id: (r.right_id, r.gap_us) for r in TM.nearest_join(left, right, "k", "ts", "id", num_partitions=n).collect()}
        for i, k, t, side in rows:
            if side == "L":
                near = min(((abs(t - u), u, j) for j, q, u, x in rows if x == "R" and q == k and None not in (t, u, q)), default=None)
                assert out[i] == ((near[2], (t - near[1]) * 10**6) if near else (None, None))
    sizes = [r["count"] for r in TM._in_ranges(left, right, "k", "ts", "id", 16).groupBy("_pid").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 150


def test_sweep_fails_on_rows_it_cannot_count(spark):
    import pytest
    good = spark.createDataFrame([(0.2, 0), (0.8, 1)], "p double, y int")
    assert E.threshold_sweep(good, "p", "y").count() == 200
    for row in ((None, 1), (float("nan"), 0), (0.4, None), (0.4, 2)):
        with pytest.raises(Exception, match="is no score|neither 0 nor 1"):
            E.threshold_sweep(good.union(spark.createDataFrame([row], "p double, y int")), "p", "y").collect()


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    from corpuslens.sources.readers import read_csv_all_string
    from corpuslens.sources.sinks import write_csv
    path = str(tmp_path / "t.csv")
    write_csv(spark.range(60_000).select(F.col("id").cast("string").alias("a"), F.lit('x "y", z').alias("b")).coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        parts = {m: read_csv_all_string(spark, path, ["a", "b"], multi_line=m) for m in (True, False)}
        assert parts[True].rdd.getNumPartitions() == 1 and parts[False].rdd.getNumPartitions() > 3
        assert parts[True].exceptAll(parts[False]).isEmpty() and parts[False].where("b = 'x \"y\", z'").count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_star_edges_salted_equals_plain(spark):
    from corpuslens.operators import minhash as M
    rnd = random.Random(4)
    rows = [(i, b, f"k{rnd.choice([0, 0, 0, 1, 2, 3]) if b == 0 else rnd.randint(0, 50)}")
            for i in range(300) for b in range(2)]
    bands = spark.createDataFrame(rows, "id long, band int, key string")
    plain = {tuple(r) for r in M.star_edges(bands, hot_rows=10**9).collect()}
    salted = {tuple(r) for r in M.star_edges(bands, hot_rows=20, salts=7).collect()}
    assert salted == plain and len(plain) > 0


def test_components_salted_equals_plain(spark):
    # a star with a 60-edge centre and a chain, salted at 10 rows per key
    edges = [(0, i) for i in range(1, 61)] + [(100 + i, 101 + i) for i in range(30)]
    v = spark.range(0, 140).select(F.col("id"))
    e = spark.createDataFrame(edges, "src long, dst long")
    plain = {r.id: r.root for r in C.connected_components(v, e).collect()}
    salted = {r.id: r.root for r in C.connected_components(v, e, hot_rows=10, salts=5).collect()}
    assert salted == plain and plain[60] == 0 and plain[130] == 100
