"""Row numbers with payload columns, strict domains, whole texts, null keys and resumed streams."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import normalize, strip
from corpuslens.operators import evaluate as E
from corpuslens.operators import splits as SP
from corpuslens.operators.labels import DomainError, check_domain
from corpuslens.operators.ranking import row_index, running_sum
from corpuslens.operators.temporal import nearest_join
from corpuslens.streaming.streams import run_to_table


@pytest.mark.parametrize("n", [5_000, 200_000])
def test_row_numbers_are_a_permutation_with_payload(spark, tmp_path, n):
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("h"), F.repeat(F.lit("x"), 30).alias("payload"))
    row_index(df, ["h", "id"]).write.parquet(str(tmp_path / "rn"))
    out = spark.read.parquet(str(tmp_path / "rn"))
    assert out.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (n, 1, n)
    running_sum(df.withColumn("one", F.lit(1)), ["h", "id"], "one").write.parquet(str(tmp_path / "cum"))
    cum = spark.read.parquet(str(tmp_path / "cum"))
    assert cum.agg(F.count_distinct("cum"), F.min("cum"), F.max("cum")).first() == (n, 1, n)


def test_sample_exact_is_exact_and_repeatable(spark):
    df = spark.range(50_000).select("id", F.repeat(F.lit("y"), 20).alias("payload"))
    one = SP.sample_exact(df, "id", 0.5).select("id")
    two = SP.sample_exact(df.repartition(7), "id", 0.5).select("id")
    assert one.count() == 25_000 and one.exceptAll(two).isEmpty()


def test_null_flag_is_an_error(spark):
    df = spark.createDataFrame([(i, f"text number {i}", 0) for i in range(12)] + [(99, "t", None)], "doc_id long, text string, is_synth int")
    with pytest.raises(SP.SplitError):
        SP.split_groups(df)


def test_check_domain_counts_every_value(spark):
    with pytest.raises(DomainError, match="^500 unexpected"):
        check_domain(spark.range(500).withColumn("v", F.col("id").cast("int") + 10), "v", [0, 1])


def test_strip_and_length_limit(spark):
    row = spark.createDataFrame([("\n\t  a b\xa0\x1c", "w " * 300)], "t string, u string")
    got = row.select(strip(F.col("t")).alias("t"), F.length(normalize(F.col("u"), "basic")).alias("all"),
                     F.length(normalize(F.col("u"), "basic", 256)).alias("cut")).first()
    assert tuple(got) == ("a b", 599, 256)


def test_nearest_join_never_matches_null_keys(spark):
    t = F.timestamp_seconds(F.col("s"))
    left = spark.createDataFrame([(1, None, 10), (2, "a", 10)], "id long, k string, s long").withColumn("ts", t)
    right = spark.createDataFrame([(7, None, 10), (8, "a", 30)], "id long, k string, s long").withColumn("ts", t)
    out = {r.left_id: r.right_id for r in nearest_join(left, right, "k", "ts", "id").collect()}
    assert out == {1: None, 2: 8}


def test_stream_resumes_where_it_ended(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    schema = "id long"
    for lot in range(3):
        spark.range(lot * 10, lot * 10 + 10).write.mode("append").parquet(src)
        got = run_to_table(spark, spark.readStream.schema(schema).parquet(src), "resume", out=out, checkpoint=ckpt)
        assert got.count() == got.distinct().count() == (lot + 1) * 10


@pytest.mark.parametrize("row", [(0, 7), (None, 1), (1, None)])
def test_labels_outside_the_list_fail(spark, row):
    df = spark.createDataFrame([(0, 0), (1, 1), row], "y int, p int")
    with pytest.raises(Exception, match="outside"):
        E.confusion_matrix(df, "y", "p", [0, 1]).collect()


def test_three_class_report(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 2), (2, 0)]
    df = spark.createDataFrame(pairs, "y int, p int")
    cells = {(r.y, r.y_pred): r.n for r in E.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()}
    assert cells == {(a, b): pairs.count((a, b)) for a in range(3) for b in range(3)}
    report = {r.row: r for r in E.classification_report(df, "y", "p", [0, 1, 2]).collect()}
    assert report["2"].support == 3 and report["2"].recall == 0.6667 and report["2"].precision == 1.0
    assert report["accuracy"].f1_score == 0.6667
