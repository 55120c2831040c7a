import datetime as dt

from pyspark.sql import functions as F

from corpuslens.functions.dates import parse_created_at
from corpuslens.functions.text import normalize

TR = "İTÜ Iğdır @ali_ğ http://x.y/z 12,5 ٣ #Tez son"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_minhash_profile_unicode(spark):
    out = one(spark, lambda c: normalize(c, "minhash"), TR)
    # lower-case turns the dotted capital into i + U+0307, a combining mark that is not a word
    # character (as in Python), so it becomes a space; URL, mention and both digit kinds are
    # replaced; punctuation runs ('#', ',', '@') become spaces; NBSP is whitespace
    assert out == "i tü iğdır USER URL NUM NUM NUM tez son"


def test_predict_profile_hashtag_and_www(spark):
    assert one(spark, lambda c: normalize(c, "predict"), "Bak #Tez www.a.b ve #école") == \
        "bak tez <url> ve #école"


def test_classical_profile_decimal_and_null(spark):
    assert one(spark, lambda c: normalize(c, "classical"), "Fiyat 12,5 TL #indirim @x_1") == \
        "fiyat <num> tl indirim <user>"
    assert one(spark, lambda c: normalize(c, "classical"), None) == ""


def test_basic_profile_keeps_case_and_truncates(spark):
    assert one(spark, lambda c: normalize(c, "basic", 10), "Merhaba   @Ali http://q") == "Merhaba @U"


def test_created_at_formats(spark):
    rows = [("Sat Dec 21 10:39:33 +0000 2024",), ("2021-03-05T01:30:00+03:00",), ("2024-12-21T23:59:59Z",),
            ("yesterday",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(parse_created_at(F.col("t")).alias("d"))
    got = [r["d"] for r in df.collect()]
    assert got == [dt.date(2024, 12, 21), dt.date(2021, 3, 5), dt.date(2024, 12, 21), None, None, None]


def test_date_quarantine(spark):
    from corpuslens.functions.dates import filter_dates_with_quarantine
    df = spark.createDataFrame([("2021-06-01T00:00:00Z",), ("junk",), ("2022-06-01",)], "createdAt string")
    kept, bad = filter_dates_with_quarantine(df, since="2021-01-01", until="2022-01-01")
    assert [r.createdAt for r in kept.collect()] == ["2021-06-01T00:00:00Z"]
    assert [r.createdAt for r in bad.collect()] == ["junk"]
