"""Inline edge rows: short texts, label casts and domains, synthetic-flag domain, arg-max ties."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.arrays import argmax, softmax
from corpuslens.functions.text import shingles, split_words
from corpuslens.operators import labels as L
from corpuslens.operators import splits as SP


def test_shingles_short_texts(spark):
    df = spark.createDataFrame([("",), ("a b c",), ("a b c d",), ("a b c d e",)], "t string")
    w = df.select(split_words(F.col("t")).alias("w"))
    got = [r.s for r in w.select(shingles(F.col("w")).alias("s")).collect()]
    assert got == [[""], ["a b c"], ["a b c d"], ["a b c d", "b c d e"]]


def test_strict_int_cast(spark):
    df = spark.createDataFrame([("1.0",), ("0",), ("9",)], "label string")
    assert [r.l for r in df.select(L.strict_int(F.col("label")).alias("l")).collect()] == [1, 0, 9]
    bad = spark.createDataFrame([("x",)], "label string")
    with pytest.raises(Exception):
        bad.select(L.strict_int(F.col("label"))).collect()


def test_label_domain_check(spark):
    df = spark.createDataFrame([(0,), (1,), (9,)], "label int")
    assert [r.label for r in L.domain_violations(df, "label", [0, 1]).collect()] == [9]
    with pytest.raises(L.DomainError):
        L.check_domain(df, "label", [0, 1])


def test_is_synth_outside_domain_fails(spark):
    df = spark.createDataFrame([(1, "a b c d e", 0, 0), (2, "x y z", 1, 2)], "doc_id long, text string, label int, is_synth int")
    with pytest.raises(SP.SplitError):
        SP.split_groups(df)


def test_argmax_tie_goes_to_first(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 3.0, 3.0],)], "z array<double>")
    got = [r.a for r in df.select(argmax(softmax(F.col("z"))).alias("a")).collect()]
    assert got == [0, 1]
