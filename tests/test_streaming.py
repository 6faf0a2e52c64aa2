from vialworks.streaming.incoming import classify, watch

SCHEMA = "fileName string, sha256 string"


def test_classes(spark):
    library = spark.createDataFrame([("A.pdf", "1"), ("b.pdf", "2"), (None, None)], SCHEMA)
    batch = spark.createDataFrame([("a.pdf", "9"), ("x.pdf", "2"), ("new.pdf", "5"), ("p.pdf", "7"), ("q.pdf", "7"), (None, None), (None, None)], SCHEMA)
    got = sorted((str(r.fileName), r.status, r.issue) for r in classify(batch, library).collect())
    assert got == [("None", "new", ""), ("None", "new", ""), ("a.pdf", "check", "same name in library"), ("new.pdf", "new", ""), ("p.pdf", "check", "same content in batch"), ("q.pdf", "check", "same content in batch"), ("x.pdf", "check", "same content in library")]
    assert classify(batch.limit(0), library).count() == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a.pdf", "1")], SCHEMA).write.parquet(str(tmp_path / "library"))
    spark.createDataFrame([("a.pdf", "1"), ("b.pdf", "2")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        arrivals = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        assert watch(arrivals, str(tmp_path / "library"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {(r.fileName, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.pdf", "check"), ("b.pdf", "new")}
