import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "label", "n", "share"]
    assert df.count() > 0


def test_every_key_has_a_callable():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_split_groups_properties(spark):
    from pyspark.sql import functions as F
    s = entry.queries()["split_groups"](spark, "/root/testdata/sf0.001")
    assert s.where(F.col("split").isin("val", "test") & (F.col("is_synth") != 0)).count() == 0
    from corpuslens.plans.fixtures import labeled_fx
    from corpuslens.operators import splits as SP
    full = SP.split_groups(labeled_fx(spark, "/root/testdata/sf0.001"))
    spans = full.where("root is not null").groupBy("root").agg(F.countDistinct("split").alias("k")).where("k > 1")
    assert spans.count() == 0
    n = labeled_fx(spark, "/root/testdata/sf0.001").count()
    target = SP.target_size(n, 0.10)
    for split in ("test", "val"):
        assert full.where(F.col("split") == split).select("root").distinct().count() == target


def test_split_groups_independent_of_partitioning(spark):
    from corpuslens.operators import splits as SP
    from corpuslens.plans.fixtures import labeled_fx
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = labeled_fx(spark, "/root/testdata/sf0.001").repartition(int(parts) + 2)
            results.append({(r.doc_id, r.split) for r in SP.split_groups(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
