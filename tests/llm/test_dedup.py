import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup, near_dedup, substring_dedup
from corpuslens.llm.components import star_components

from .conftest import hard_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_components(rows, k=2, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    live = [(i, s) for i, s in sets if s and i is not None]
    for a, (i, s) in enumerate(live):
        for j, t in live[a + 1:]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), find(i) if s and i is not None else i, i == (find(i) if s and i is not None else i))
                   for i, s in sets], key=repr)


def brute_passages(rows, width=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            if i is not None and first.get(key, i) >= i:
                first[key] = i
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def with_copies(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    at = max(i for i, _ in rows) + 1
    more = []
    for n, (i, t) in enumerate(rows[:12]):  # chains of near copies, ever further from the first
        words = t.split(" ")[:400]
        for step in range(8):
            words = list(words)
            for x in range(step, len(words), 60):
                words[x] = f"edit{n}x{step}x{x}"
            more.append((at, " ".join(words)))
            at += 1
    return rows + more


@pytest.mark.parametrize("digests", [True, False])
def test_exact_groups(docs_of, small_docs, digests):
    for rows in (hard_rows(), with_copies(small_docs), []):
        out = exact_dedup.exact_groups(docs_of(rows), all_digests=digests)
        want = brute_exact(rows)
        if digests:
            assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
        else:
            assert got(out, "doc_id", "keep_id", "group_size", "kept") == [r[:4] for r in want]
            shas = {(r[0], r[4]) for r in want}
            assert all((r.doc_id, r.text_sha256) in shas for r in out.where("text_sha256 is not null").collect())


def test_exact_dedup_keeps_one_row_of_each_text(docs_of, spark):
    rows = hard_rows()
    docs = docs_of(rows).withColumns({"_len": F.lit(1), "_sha": F.lit("x"), "_alike": F.lit(True)})
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in rows})
    assert {r.doc_id for r in out.where("doc_id in (5, 6)").collect()} == {6}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_near_components_equal_brute_force(docs_of, small_docs):
    for rows in (hard_rows(), with_copies(small_docs), []):
        out = near_dedup.near_components(docs_of(rows))
        assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def test_near_group_without_a_common_hub(docs_of):
    """A hundred copies around a text that is not among them: pairs are near the threshold, no hub reaches all."""
    import random
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(100):
        words = list(base)
        for x in rng.sample(range(200), rng.choice([6, 9, 12, 15, 20, 26])):
            words[x] = f"n{i}x{x}"
        rows.append((i + 1, " ".join(words)))
    out = near_dedup.near_components(docs_of(rows))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def test_near_dedup_keeps_the_smallest_id(docs_of):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3] + ["z"])), (3, "other text of some words"), (4, None), (None, None)]
    docs = docs_of(rows).withColumn("_drop", F.lit(1))
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted([r.doc_id for r in out.collect()], key=repr) == [1, 3, 4, None]


@pytest.mark.parametrize("small", [500_000, 0])
def test_star_components(spark, monkeypatch, small):
    monkeypatch.setattr("corpuslens.llm.components.SMALL_EDGES", small)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 5), (5, 1), (7, 7), (9, 5), (None, 3)]
    out = star_components(spark.createDataFrame(links, "src long, dst long"))
    want = [(i, 100) for i in range(100, 161)] + [(1, 1), (5, 1), (9, 1)]
    assert got(out, "id", "root") == sorted(want, key=repr)
    assert star_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_repeated_passages_equal_brute_force(docs_of, small_docs):
    for rows in (hard_rows(), with_copies(small_docs), []):
        out = substring_dedup.repeated_passages(docs_of(rows))
        assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(rows)


def test_repeated_passages_short_windows(docs_of):
    rows = [(3, "x a b c d e y"), (1, "p a b c d q"), (2, "a b c d"), (5, "c d e y z"), (5, "q q a b c"), (9, "a b c d")]
    out = substring_dedup.repeated_passages(docs_of(rows), width=3)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(rows, 3)
    spans = {(r.doc_id, r.n_words): r.spans for r in out.collect()}
    assert spans[3, 7] == [[1, 5]] and spans[2, 4] == [[0, 4]] and spans[1, 6] is None


def test_window_anchor_is_shared_by_equal_windows():
    import numpy as np
    words = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    a, b = substring_dedup.window_anchors(words, 50), substring_dedup.window_anchors(words[300:], 50)
    assert (a[300:] == b).all() and len(np.unique(a)) < len(a) / 8


def common_base(seed, n, words=160, edits=24):
    """Documents of similarity about 0.5 to 0.8 to each other: a common text with some words of their own, so that
    they share bands and few of them are links."""
    import numpy as np
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    rows = []
    for d in range(n):
        own = list(base)
        for at in rng.choice(words, size=int(rng.integers(2, edits)), replace=False):
            own[at] = f"own{seed}x{d}x{at}"
        rows.append((seed * 10_000 + d, " ".join(own)))
    return rows


def test_near_components_of_a_hot_passage(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 20)  # buckets of more rows are dealt over sub-keys
    monkeypatch.setattr(near_dedup, "PART", 20)
    rows = common_base(1, 120) + common_base(2, 60, edits=40) + [(50_000 + i, "the very same text of a group of copies") for i in range(80)]
    want = brute_components(rows)
    assert 30 < len({r[2] for r in want}) < len(rows) - 60
    out = near_dedup.near_components(docs_of(rows).withColumns({"band": F.lit(1), "id": F.lit(2), "root": F.lit(3)}))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want


def test_signature_verification_bound():
    assert 70 <= near_dedup.least_agreement(80) <= 74 and near_dedup.least_agreement(100) == 128
    assert near_dedup.least_agreement(1) == 0


def test_signature_columns_count_differing_minima(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 128)).astype(np.uint8)
    b = np.where(rng.random((40, 128)) < rng.random((40, 1)), a, rng.integers(0, 256, (40, 128))).astype(np.uint8)
    rows = [(i, x.view(np.int64).tolist(), y.view(np.int64).tolist()) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    found = {r.i: r.n for r in df.select("i", near_dedup._disagree("x", "y").alias("n")).collect()}
    assert found == {i: int((a[i] != b[i]).sum()) for i in range(40)}


def exchanged(df):
    """The columns that each shuffle of a plan carries."""
    import re
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return [{c.split("#")[0].strip() for c in line.split(",")} for line in found]


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_exact_dedup_with_and_without_broadcast(docs_of, small_docs, monkeypatch, small):
    monkeypatch.setattr(exact_dedup, "SMALL_KEYS", small)
    rows = hard_rows() + with_copies(small_docs) + [(3000 + i, "One text of MANY copies") for i in range(300)]
    docs = docs_of(rows)
    for digests in (True, False):
        out = exact_dedup.exact_groups(docs, all_digests=digests)
        assert got(out, "doc_id", "keep_id", "group_size", "kept") == [r[:4] for r in brute_exact(rows)]
    kept = exact_dedup.exact_dedup(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted([max((x for x in ids if x is not None), default=None) for ids in groups.values()], key=repr)
    found = sorted([r.doc_id for r in kept.collect()], key=repr)
    assert found == want


def test_no_text_is_shuffled_to_find_exact_copies(spark, monkeypatch):
    """Every exchange of the plan is above a projection without the text column."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for small in (1_000_000, 0):
        monkeypatch.setattr(exact_dedup, "SMALL_KEYS", small)
        for digests in (True, False):
            shuffles = exchanged(exact_dedup.exact_groups(docs, all_digests=digests))
            assert shuffles and not any(c & {"text", "_text"} for c in shuffles)


def test_near_dedup_writes_no_long_plan(docs_of, monkeypatch):
    """The driver keeps several texts of a plan at each adaptive step: each table is made from few readings of others."""
    from corpuslens.llm import common, components
    read = {}

    def counting(df, name):
        read[name] = max(read.get(name, 0), df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return common.stored(df, name)

    monkeypatch.setattr(near_dedup, "stored", counting)
    monkeypatch.setattr(components, "stored", counting)
    docs = docs_of(common_base(3, 60) + common_base(4, 30, edits=40))
    out = near_dedup.near_dedup(docs, k=2)
    read["result"] = out._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert {r.doc_id for r in out.collect()} == {r[0] for r in brute_components(common_base(3, 60) + common_base(4, 30, edits=40)) if r[3]}
    assert {"edges", "roots", "open", "pairs"} <= set(read)
    assert max(read.values()) <= 9 and read["edges"] <= 4, read
