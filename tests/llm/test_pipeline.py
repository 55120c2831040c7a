import corpus_pipeline
import __spark_entry__ as entry
from corpuslens.llm import decontaminate, exact_dedup, lang_id, packing
from corpuslens.llm.common import in_python

from .conftest import SMALL, hard_rows
from .test_dedup import LOWER, brute_components
from .test_text import brute_leaks, encode


def test_queries_are_registered():
    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} >= {f"op{n}_" + s for n, s in enumerate(
        ["near_dedup", "quality", "pii", "packing", "url_filter", "exact_dedup", "language", "html_text", "substring_dedup", "decontaminate"], 1)}
    assert "pipeline" in names


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in lang_id.filter_language(docs).collect()]
    best = {}
    for i, t in rows:
        key = t.translate(LOWER)
        best[key] = max(best.get(key, (i, t)), (i, t))
    rows = list(best.values())
    kept = {r[0] for r in brute_components(rows, k=5) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    bad = {d for d, _ in brute_leaks(rows, bench)}
    rows = sorted(r for r in rows if r[0] not in bad)
    out = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").sum("length").collect()
    assert sorted((r[0], r[1]) for r in out) == [(i, len(ids)) for (i, _), ids in zip(rows, encode([t for _, t in rows]))]


def test_stages_keep_columns_and_take_hard_rows(spark, docs_of):
    for rows in (hard_rows(), []):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.schema.names == docs.schema.names, name
            assert {r.doc_id for r in out.collect()} <= {i for i, _ in rows}
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_workers_give_up_the_words_of_packing(spark, docs_of):
    """A Python worker outlives the packing stage; tasks of other operators find no encoder in it."""
    docs = docs_of([(i, f"word{i} and some more") for i in range(60)])

    def encoders(frames):
        import gc

        import pandas as pd
        for _ in frames:
            yield pd.DataFrame({"n": [sum(type(o).__name__ == "WordEncoder" for o in gc.get_objects())]})

    for _ in range(2):
        assert packing.pieces(docs).count() >= 60
        assert {r.n for r in in_python(docs, encoders, "n long").collect()} == {0}
