"""Queries on tables in which one value stands in very many rows."""

from pyspark.sql import functions as F

from vialworks.plans import relations, rules


def written(spark):
    """Bytes that shuffles have written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_manual_map_counts_a_hot_key_once(spark, tmp_path):
    n = 1500
    i = F.col("id")
    o = spark.range(n).select(i.alias("override_no"), F.concat(F.lit("e"), i).alias("productId"), F.struct(F.when(i % 3 > 0, "-").otherwise(F.concat(F.lit("n"), i)).alias("productName"), F.when(i % 5 > 0, "-").alias("msdsNo"), F.concat(F.lit("f"), (i / 2).cast("int")).alias("fileName")).alias("matchTarget"))
    s = spark.range(n).select(i.alias("row_no"), F.concat(F.lit("e"), i + 10).alias("id"), F.when(i % 2 > 0, "-").otherwise(F.concat(F.lit("n"), i)).alias("productName"), F.when(i % 7 > 0, "-").otherwise("").alias("msdsNo"))
    o.write.parquet(f"{tmp_path}/msds_overrides.parquet")
    s.write.parquet(f"{tmp_path}/msds_sample.parquet")
    rows = o.select("override_no", "productId", "matchTarget.*").collect()
    files = {}
    for r in rows:
        for x in (("id", r.productId), ("name", r.productName), ("number", r.msdsNo)):
            files.setdefault(x, set()).add(r.fileName)
    want = {}
    for r in s.collect():
        fs = set().union(*[files.get(x, set()) for x in (("id", r.id), ("name", r.productName), ("number", r.msdsNo))])
        if fs:
            want[r.row_no] = (min(fs), len(fs))
    before = written(spark)
    got = {r.row_no: (r.file, r.files) for r in relations.jon14_manual_map(spark, str(tmp_path)).collect()}
    assert got == want
    assert written(spark) - before < 1_500_000


def test_pictograms_split_each_text_once(spark, tmp_path):
    texts = ["급성 독성 : 구분 4; H-225", "급성독성, 구분4", "급성독성,구분4", "인화성 액체/구분2", "인화성 액체 (구분 2)\n고압 가스", "h2000", "분류되지 않음 H225", ";;", "", None, "구분1 산화성；h41　0", "H 314 눈 손상성:구분 1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = rules.rul1_inferred_pictograms(spark, str(tmp_path))
    assert {r.doc_id: r.codes for r in df.collect()} == {0: "GHS02,GHS07", 1: "", 2: "GHS07", 3: "", 4: "GHS02,GHS04", 5: "GHS01", 6: "", 7: "", 8: "", 10: "GHS03,GHS09", 11: "GHS05"}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4
