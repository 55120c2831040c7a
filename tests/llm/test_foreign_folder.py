"""Training-data operators on tables of the caller's own, started outside the repository folder."""

from tests.test_foreign_folder import run_elsewhere


def test_operators_on_own_tables_elsewhere(tmp_path):
    out = run_elsewhere(tmp_path, """
from corpuslens.llm import conversation, lang_id, near_dedup, packing, ranked_search, substring_dedup
docs = spark.createDataFrame([(i, "one two three four five six " * 3 + str(i // 2), "en", "s", 1) for i in range(8)],
                             "doc_id long, text string, lang string, source string, n_chars long")
print("near", near_dedup.near_components(docs).count())
print("lang", lang_id.identify(docs).count())
print("packed", packing.pack_digest(docs).count() > 0)
print("repeated", substring_dedup.repeated_passages(docs).count())
items = docs.selectExpr("doc_id AS item_id", "text").limit(1)
print("found", ranked_search.search(docs, items).count() > 0)
talk = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
print("talks", conversation.repair_damaged(talk).count())
""")
    for line in ("near 8", "lang 8", "packed True", "repeated 8", "found True", "talks 1"):
        assert line in out
