"""Verified near-duplicates against brute force over all pairs, and salted against plain joins."""

import itertools

import pytest

from corpuslens.operators import minhash as M
from corpuslens.operators.splits import near_dup_components
from corpuslens.plans import registry

SF = "/root/testdata/sf0.001"


def _sets(rows):
    return {r.id: frozenset(r.hashes) for r in rows.collect()}


def _linked(sets, threshold=M.DEFAULT_THRESHOLD):
    return {(b, a) for a, b in itertools.combinations(sorted(sets), 2)
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def _roots(ids, links):
    root = {i: i for i in ids}
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


@pytest.fixture(scope="module")
def chained(spark):
    """A bucket minimum unlike the rest, chains of near copies, equal texts, empty and null texts."""
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base[:45]))]
    for step in range(12):
        rows.append((10 + step, " ".join(base[step:] + [f"v{i}" for i in range(step)])))
    rows += [(40 + i, " ".join(["other"] + base[20:60])) for i in range(5)]
    rows += [(60, ""), (61, None), (62, "lone words"), (63, "lone words")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_brute_force(spark, chained):
    for docs in (chained, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        sets = _sets(M.shingle_table(M.shingle_rows(docs)))
        want = _roots(sets, _linked(sets))
        got = near_dup_components(docs, "doc_id", "text", M.RECALL_BANDS, M.RECALL_ROWS, verify=True)
        assert {r.id: r.root for r in got.collect()} == want


def test_pairs_lose_no_link_between_different_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = _sets(M.shingle_table(M.shingle_rows(docs)))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    want = _linked({i: s for s, i in rep.items()}) | {(i, rep[s]) for i, s in sets.items() if rep[s] != i}
    got = registry.all_queries()["near_dup_pairs"](spark, SF)
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_salting_changes_nothing(spark, chained):
    sets = M.shingle_table(M.shingle_rows(chained)).cache()
    classes = M.set_classes(sets, hot_rows=1, salts=3)
    assert sorted(classes.collect()) == sorted(M.set_classes(sets).collect())
    own, buckets = M.class_buckets(sets, classes)
    pairs = M.bucket_pairs(buckets, hot_rows=1, salts=3)
    assert sorted(pairs.collect()) == sorted(M.bucket_pairs(buckets).collect())
    salted = M.verify_edges(pairs, own, hot_rows=0, salts=3)
    assert sorted(salted.collect()) == sorted(M.verify_edges(pairs, own).collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup_components(none, "doc_id", "text", M.RECALL_BANDS, M.RECALL_ROWS, verify=True).isEmpty()
