from pyspark.sql import functions as F

from vialworks.llm import survivor


def test_usable_values(spark):
    rows = [("Foo Thinner 60", "Foo_Thinner_60_A1_77.pdf", True), ("Foo Thinner 60 (A1)", "Foo_Thinner_60_A1_77.pdf", False), ("FooThinner60(A1)", "Foo_Thinner_60_A1_77.pdf", False), ("Foo Thi…", None, True), ("Foo (A", None, True), (None, "a.pdf", False), ("[개정] Foo 1", "Foo_1_2.pdf", False), ("Foo", None, False)]
    df = spark.createDataFrame(rows, "n string, w string, want boolean")
    assert df.where(survivor.lost_end(F.col("n"), F.col("w")) != F.col("want")).count() == 0
    paths = [("/pdf/a.pdf", True), ("/pdf/금형/a.PDF", True), ("/pdf/a.pdf.part", False), ("/pdf/~$a.tmp", False), ("/pdf/~$a.pdf", False), ("/pdf/", False), ("/pdf/.pdf", False), ("a.hwp", False), ("/pdf/a.pd", False)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    assert df.where(survivor.finished_pdf(F.col("p")) != F.col("want")).count() == 0
    stand = [("N/A", True), (" ", True), (None, True), ("　", True), ("(빈칸)", True), ("Foo", False)]
    df = spark.createDataFrame(stand, "v string, want boolean")
    assert df.where(survivor.stand_in(F.col("v")) != F.col("want")).count() == 0


def field(at=None, **more):
    return survivor.Field(**{"value": F.col("v"), "usable": F.col("v").isNotNull(), "before": (-F.col("rank"),), "at": F.lit(None).cast("int") if at is None else F.col(at), "after": (-F.col("row_no"),), **more})


def test_survivors(spark):
    rows = [("a", 1, None, 2), ("a", 2, "x", 2), ("a", 3, "y", 1), ("a", 4, "z", 1), ("b", 5, None, 1), ("b", 6, None, 1), ("c", 7, "only", 1), (None, 8, "q", 1), (None, 9, "r", 1)]
    df = spark.createDataFrame(rows, "id string, row_no long, v string, rank int").withColumn("field_name", F.lit("clash"))
    got = survivor.survivors(df, "id", "row_no", {"v": field()})
    assert [(r.id, r.field_name, r.row_no) for r in got.collect()] == [("a", "v", 3)]
    assert survivor.survivors(df.limit(0), "id", "row_no", {"v": field()}).count() == 0


def test_survivors_by_precedence(spark):
    order = spark.createDataFrame([("z", "m"), ("m", "a"), ("z", "a"), ("p", "q"), ("q", "p")], "older string, newer string")
    rows = [
        ("chain", 1, "z", None, 1), ("chain", 2, "a", None, 1), ("timed", 3, "z", 5, 1), ("timed", 4, "a", 4, 1), ("half", 5, "z", 5, 1), ("half", 6, "a", None, 1), ("trust", 7, "z", None, 1), ("trust", 8, "a", None, 2),
        ("none", 9, "s", None, 1), ("none", 10, "t", None, 1), ("loop", 11, "q", None, 1), ("loop", 12, "p", None, 1), ("lone", 13, "a", None, 1),
    ]
    df = spark.createDataFrame(rows, "id string, row_no long, v string, t int, rank int")
    fields = {"v": field("t"), "w": field("t")}
    got = {(r.id, r.field_name): r.row_no for r in survivor.survivors(df, "id", "row_no", fields, {"v": order}).collect()}
    assert {k[0]: n for k, n in got.items() if k[1] == "v"} == {"chain": 2, "timed": 3, "half": 6, "trust": 7, "none": 9, "loop": 11}
    assert {k[0]: n for k, n in got.items() if k[1] == "w"} == {"chain": 1, "timed": 3, "half": 5, "trust": 7, "none": 9, "loop": 11}
    assert survivor.survivors(df.limit(0), "id", "row_no", fields, {"v": order}).count() == 0


def test_basis_says_what_decided(spark):
    learned = spark.createDataFrame([("u", "v", 5)], "older string, newer string, n long")
    rows = [("tie", "b", None), ("tie", "c", None), ("known", "u", None), ("known", "v", None), ("same", "b", 3), ("same", "a", 3)]
    df = spark.createDataFrame(rows, "g string, v string, t int")
    got = {r.g: (r.v, r.basis) for r in survivor.latest_values(df, "g", "v", "t", learned).collect()}
    assert got == {"tie": ("b", "smallest"), "known": ("v", "precedence"), "same": ("a", "time")}


def test_currency(spark):
    rows = [(g, v, t) for g in ("a", "b", "c") for v, t in (("old", 1), ("new", 2))] + [("d", "old", None), ("d", "new", None), ("e", "old", 5), ("e", "new", None), ("f", "one", None), (None, "old", 1)]
    df = spark.createDataFrame(rows, "g string, v string, t int")
    learned = survivor.precedence(df, "g", "v", "t")
    assert [(r.older, r.newer, r.n) for r in learned.collect()] == [("old", "new", 3)]
    got = {r.g: (r.v, r.basis) for r in survivor.latest_values(df, "g", "v", "t", learned).collect()}
    assert got["a"] == ("new", "time") and got["d"][0] == "new" and got["e"] == ("new", "precedence") and got["f"] == ("one", "only") and None not in got
    assert survivor.latest_values(df.limit(0), "g", "v", "t", learned).count() == 0


def test_currency_over_several_steps(spark):
    path = [(g, v, t) for g in ("a", "b") for v, t in (("z1", 1), ("m2", 2))] + [(g, v, t) for g in ("c", "d") for v, t in (("m2", 1), ("a3", 2))]
    apart = [("e", "p1", 1), ("e", "x", 2), ("e", "q3", 3), ("f", "p1", 1), ("f", "y", 2), ("f", "q3", 3)]
    asked = [("g", "z1", None), ("g", "a3", None), ("h", "p1", None), ("h", "q3", None), ("i", "k", 1), ("i", "m2", 2), ("i", "a3", None), ("j", "u", None), ("j", "s", None), ("k", "u", 7), ("k", "s", 7)]
    df = spark.createDataFrame(path + apart + asked, "g string, v string, t int")
    learned = survivor.precedence(df, "g", "v", "t", block=2)
    assert {(r.older, r.newer): r.n for r in learned.collect()} == {("z1", "m2"): 2, ("m2", "a3"): 2, ("p1", "x"): 1, ("p1", "y"): 1, ("x", "q3"): 1, ("y", "q3"): 1, ("p1", "q3"): 2, ("k", "m2"): 1}
    got = {r.g: (r.v, r.basis) for r in survivor.latest_values(df, "g", "v", "t", learned).collect()}
    assert got["g"][0] == "a3" and got["h"][0] == "q3" and got["i"] == ("a3", "precedence") and got["j"][0] == "s" and got["k"] == ("s", "time")
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "older string, newer string")
    assert {(r.older, r.newer) for r in survivor.transitive(loop).collect()} == {(x, y) for x in "abc" for y in "de"} | {("d", "e")}
