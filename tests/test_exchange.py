import json

from vialworks.sinks import files as sinks
from vialworks.sources import files
from vialworks.streaming import upkeep


def test_json_lists(spark, tmp_path):
    one, two, bad = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    one.write_text("\ufeff" + json.dumps([{"id": "x", "n": 1}, {"id": None}]), encoding="utf-8")
    two.write_text(json.dumps({"products": [{"id": "y"}]}), encoding="utf-8")
    bad.write_text("no json", encoding="utf-8")
    read = lambda p, k=None: [(r.id, r.n) for r in files.read_json_list(spark, str(p), "id string, n int", k).collect()]
    assert read(one) == [("x", 1), (None, None)] and read(two, "products") == [("y", None)] and read(bad) == [] and read(tmp_path / "none.json") == []
    path, df = files.first_available(spark, [str(bad), str(tmp_path / "none.json"), str(two)], "id string", "products")
    assert path == str(two) and df.count() == 1
    assert files.first_available(spark, [str(bad)], "id string")[0] is None
    import pytest

    with pytest.raises(FileNotFoundError):
        files.load_products(spark, str(one), str(bad), str(two), "id string", is_local=False)
    assert files.load_products(spark, str(bad), str(bad), str(two), "id string", is_local=True)[0] == str(two)


def test_listing_and_maps(spark, tmp_path):
    (tmp_path / "in" / "_archive1").mkdir(parents=True)
    for name in ("a.pdf", "가 나.pdf", "b.txt", "_archive1/c.pdf"):
        (tmp_path / "in" / name).write_bytes(b"x" + name.encode())
    got = {r.relativePath: r.sha256 for r in files.list_files(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.pdf", "가 나.pdf"} and len(got["a.pdf"]) == 64
    (tmp_path / "m.json").write_text(json.dumps([{"id": "p", "file": "a.pdf"}, {"source": "q"}]))
    (tmp_path / "n.json").write_text(json.dumps({"r": "b.pdf"}))
    assert [(r.source, r.file) for r in files.read_map(spark, str(tmp_path / "m.json")).collect()] == [("p", "a.pdf")]
    assert [(r.source, r.file) for r in files.read_map(spark, str(tmp_path / "n.json")).collect()] == [("r", "b.pdf")]
    df = spark.createDataFrame([("pdf/a", "pdf/b"), ("c", "d")], "old string, new string")
    assert {(r.old, r.new) for r in files.expand_renames(df).collect()} == {("pdf/a", "pdf/b"), ("a", "b"), ("/pdf/a", "/pdf/b"), ("c", "d")}


def test_reviewed_uploads(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "v": "1"}\n{"id": ""}\nno json\n')
    got = [(r.id, r.problem) for r in files.read_reviewed(spark, str(tmp_path / "r.jsonl"), "id string, v string", ["id"]).collect()]
    assert got == [("a", None), ("", "missing: id"), (None, "not readable")]


def test_rows_to_entries(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, " "), (4, "b"), (5, None)], "o int, name string")
    assert [r.entry for r in files.rows_to_entries(df, "o", ["name"]).orderBy("o").collect()] == [None, 1, 1, 2, 2]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'a "b", c'), (None, "x\r\ny")], "n string, `v w` string")
    sinks.write_csv(df, str(tmp_path / "o"), header=["name", "value"], files=1)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "o").glob("part-*")))
    assert raw.startswith("\ufeffname,value\r\n".encode()) and b"'=1+1,\"a \"\"b\"\", c\"\r\n" in raw and b',"x\r\ny"\r\n' in raw
    sinks.write_csv(df.limit(0), str(tmp_path / "e"), files=1)
    assert b"".join(p.read_bytes() for p in (tmp_path / "e").glob("part-*")) in (b"", "\ufeffn,v w\r\n".encode())  # a table without a partition gives no part


def test_releases_are_published_as_a_whole(spark, tmp_path):
    df = spark.range(3)
    sinks.publish({"a": df, "b": df.limit(1)}, str(tmp_path), "v1")
    assert spark.read.parquet(sinks.current(spark, str(tmp_path)) + "/b.parquet").count() == 1
    try:
        sinks.publish({"a": df, "b": df.selectExpr("raise_error('x') as y")}, str(tmp_path), "v2")
    except Exception:
        pass
    assert sinks.current(spark, str(tmp_path)).endswith("/v1")
    sinks.publish({"a": df}, str(tmp_path), "v3")
    assert sinks.current(spark, str(tmp_path)).endswith("/v3")


def test_upkeep(spark, tmp_path):
    q = spark.createDataFrame([("a", "old", "keep", "1"), ("b", "old", None, "1")], "k string, sha string, who string, lastSeen string")
    n = spark.createDataFrame([("a", "new"), ("c", "new")], "k string, sha string")
    got = {r.k: (r.sha, r.who, r.state, r.lastSeen) for r in upkeep.upsert_queue(q, n, "k", ["who"], "2").collect()}
    assert got == {"a": ("new", "keep", "present", "2"), "b": ("old", None, "missing", "1"), "c": ("new", None, "present", "2")}
    f = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    r = spark.createDataFrame([("a", False), ("b", True), (None, None)], "k string, failed boolean")
    assert {x.k for x in upkeep.unread(f, r, "k").collect()} == {"c", None} and {x.k for x in upkeep.unread(f, r, "k", "failed").collect()} == {"b", "c", None}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"k": "a"}\n')
    for _ in range(2):
        stream = spark.readStream.schema("k string").json(str(tmp_path / "s"))
        upkeep.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
