import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a ``documents`` table from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: rows that every operator must take: nulls, empties, white space, repeats, ties, one very long text
def hard_rows():
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(300))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, base), (6, base.upper()), (6, base.upper()), (7, base + " end"),
            (None, base), (None, None), (8, "Ünï cödé \U0001f600 wörds"), (9, "x" * 50_000), (10, " ".join(["same"] * 400)),
            (11, "a b"), (12, "b a"), (13, " ".join(f"long{i}" for i in range(30_000)))]
