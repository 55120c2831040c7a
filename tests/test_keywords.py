"""The compiled matcher, composed queries and attribution against plain re-statements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import attribution as AT
from corpuslens.operators import keywords as K
from corpuslens.operators import matcher as M

TOKENS = re.compile(r"[^\W]+")


def plain_codes(text, entries):
    toks = [t for t in re.split(r"[^\w]+", (text or "").lower()) if t]
    grams = {" ".join(toks[i:j]) for i in range(len(toks)) for j in range(i + 1, min(i + 6, len(toks)) + 1)}
    return {code for code, term in entries if K.norm_term(term) and K.norm_term(term) in grams}


def codes_of(spark, texts, entries):
    phrases = M.compile_phrases(entries)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {}
    for r in df.select("i", M.phrase_bits(F.col("text"), phrases).alias("b")).collect():
        out[r.i] = {c for at, c in enumerate(phrases.codes) if r.b[at // M.BITS] >> at % M.BITS & 1}
    return out


def test_matcher_equals_token_grams_on_random_texts(spark):
    rnd = random.Random(2)
    alphabet = ["ab", "a", "b", "abc", "é", "İ", "x_1", "ß"]
    entries = [(f"c{rnd.randint(0, 90)}", " ".join(rnd.choices(alphabet, k=rnd.randint(1, 4)))) for _ in range(120)]
    texts = [rnd.choice(["", "!", " "]).join([]) + "".join(rnd.choice(alphabet + ["AB", "É"]) + rnd.choice([" ", ", ", "-", "", "\n "])
             for _ in range(rnd.randint(0, 25))) for _ in range(200)] + [None, "", "...", "a" * 50_000 + " ab a"]
    found = codes_of(spark, texts, entries)
    assert M.compile_phrases(entries).width == 2  # more codes than one long holds
    assert [found[i] for i in range(len(texts))] == [plain_codes(t, entries) for t in texts]


def test_shorter_phrases_and_overlaps_are_found(spark):
    entries = [("long", "yeni büyük şehir"), ("short", "yeni"), ("tail", "büyük şehir"), ("both", "yeni"), ("none", "büyükşehir"), ("empty", "!")]
    found = codes_of(spark, ["Yeni  BÜYÜK\nşehir", "yenibüyük şehir", "büyük, Yeni"], entries)
    assert found == {0: {"long", "short", "tail", "both"}, 1: set(), 2: {"short", "both"}}


def test_catalogue_without_phrases(spark):
    assert codes_of(spark, ["a", None], [("x", "!"), ("y", "")]) == {0: set(), 1: set()}


def test_queries_are_alias_and_topic_and_not_excluded(spark):
    texts = {1: "Bilkent rezalet", 2: "bilkent", 3: "rezalet", 4: "Bilkent rezalet kampanya", 5: "METU Bilkent: ders, rezalet", 6: None}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    phrases = M.compile_phrases((f"{kind}:{code}", term) for kind, code, _, term, _ in K.catalog_rows())
    got = {r.id: r.matched for r in M.match_queries(df, "text", phrases, K.combo_queries()).collect()}
    rank = {(r.university, r.group): r.combo_rank for r in K.combo_catalog(spark).collect()}
    assert got == {1: [rank["BILKENT", "guclu_negatif"]],
                   5: sorted(rank[u, g] for u in ("ODTU", "BILKENT") for g in ("guclu_negatif", "akademik"))}


def test_combo_catalog_is_every_pair_in_order(spark):
    rows = sorted(K.combo_catalog(spark).collect(), key=lambda r: r.combo_rank)
    assert [r.combo_rank for r in rows] == list(range(70)) and not any(r.skipped for r in rows)
    assert rows[1].combo == "YTU_guclu_pozitif" and rows[1].query.startswith('("Yıldız Teknik" OR YTÜ OR ytü) ("mükemmel" OR')
    assert rows[0].query.endswith('-"AYT" since:2021-01-01 until:2022-01-01')
    assert K.combo_catalog(spark, None, None).first().query.endswith('-"AYT"')


@pytest.mark.parametrize("small", [10_000, 5])
def test_tag_join_of_a_large_catalogue_is_shuffled_and_alike(spark, small):
    texts = [(1, "Bugün öğrenci işleri yine rezalet rezalet, iyi ki Bilkent var"), (2, "öğrenci"), (3, "iyi ki"), (4, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.kind, r.code, r.n_hits) for r in K.tag_join(df, "id", "text", K.catalog_df(spark), small=small).collect()}
    assert got == {(1, "topic", "idari", 1), (1, "topic", "guclu_negatif", 2), (1, "topic", "guclu_pozitif", 1),
                   (1, "institution", "BILKENT", 1), (3, "topic", "guclu_pozitif", 1)}


# ---- attribution

HITS = "rank int, seq long, text string"


def attributed(table):
    return {(r.batch, r["rank"], r.seq) for r in table.read().collect()}


def test_later_batches_change_nothing_and_replays_leave_no_repeats(spark, tmp_path):
    batches = [[(5, 1, "a"), (3, 2, "b"), (3, 4, "b"), (4, 3, "b"), (1, 9, None)], [(0, 5, "a"), (9, 6, "c"), (2, 7, "c")], [(0, 8, "b"), (1, 9, "d")]]
    table = AT.AttributionTable(spark, str(tmp_path / "t"))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, HITS)
        table.append(df, n)
        before = attributed(table)
        table.append(df.unionByName(df), n)  # a replayed batch, its rows twice
        assert attributed(table) == before
    assert attributed(table) == {(0, 5, 1), (0, 3, 2), (1, 2, 7), (2, 1, 9)}


def test_streamed_attribution_survives_a_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    table = AT.AttributionTable(spark, out)
    want = set()
    seen = {}
    for n, rows in enumerate([[(2, 1, "a"), (1, 2, "b")], [(0, 3, "a"), (0, 4, "c")], [(7, 5, "d"), (0, 6, "c")]]):
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(src)
        query = table.stream(spark.readStream.schema(HITS).parquet(src), ckpt)  # a new query each time
        query.awaitTermination()
        for rank, seq, text in sorted(rows):
            if text not in seen:
                seen[text] = (n, rank, seq)
        want = set(seen.values())
        assert attributed(table) == want
