import random

import pytest
from pyspark.sql import functions as F

from vialworks.llm import scans, statements, truncation

def fields():
    return {"h": F.col("h")}


PLACES = ["mixing bay", "spray booth", "tool crib", "drum store"]
THINGS = ["vapour", "mist", "fume", "spray"]


@pytest.fixture(scope="module")
def table(spark):
    random.seed(7)
    p, t = (lambda: random.choice(PLACES)), (lambda: random.choice(THINGS))
    makers = [lambda: f"Keep away from {t()} while working in the {p()}.", lambda: f"Breathing the {t()} may bring on headache.", lambda: f"No eating or smoking in the {p()}", lambda: f"H{random.randint(200, 299)} Leaves a film on floors in the {p()} after {random.randint(2, 9)} hours."]
    rows = [(i, "clean", [random.choice(makers)() for _ in range(3)]) for i in range(600)]
    bad = [
        (1001, "cut", ["Keep away from vapour while wor", "Breathing the mist may bring on headache."]), (1002, "cut", ["Breathing the fume may..."]), (1003, "cut", ["Keep away from mist while working in the…"]),
        (1004, "cut", ["Keep away from spray while working in the spray booth"]), (1005, "cut", [None, "", "Leaves a film on floors in the"]), (1006, "cut", None), (1007, "cut", []),
        (1011, "scan", ["Keep away from vap-\nour while working in the tool crib.", "Breathing the mist may bring on headache."]), (1012, "scan", ["Breathing the vapour", "may bring on headache.", "No eating or smoking in the tool crib"]),
        (1013, "scan", ["Keep away from mist", "SAFETY SHEET Foo 12 Page 3 of 8", "while working in the mixing bay."]), (1014, "scan", ["Breathing the mlst may bririg on headache."]), (1015, "scan", ["Breathing the mist  .. may bring on headache.", "- 4 -"]),
    ]
    return spark.createDataFrame(rows + bad, "k long, src string, h array<string>").withColumn("item_no", F.lit("clash"))


def test_cut_items(table):
    found = truncation.find_truncated(table, "k", "src", fields())
    assert {(r.k, r.item_no) for r in found.collect()} == {(1001, 1), (1002, 1), (1003, 1), (1005, 3)}
    assert found.where("k = 1002").first().marked


def test_damaged_items(table):
    got = {(r.k, r.item_no) for r in scans.find_damaged(table, "k", fields()).collect()}
    assert got == {(1011, 1), (1012, 1), (1012, 2), (1013, 1), (1013, 2), (1013, 3), (1014, 1), (1015, 1), (1015, 2)}


def test_repaired_statements(table):
    rows = scans.clean_statements(table, "k", fields()).where("k > 1010").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.k, r.statement_no)):
        got.setdefault(r.k, []).append(r.statement)
    assert got == {
        1011: ["Keep away from vapour while working in the tool crib.", "Breathing the mist may bring on headache."],
        1012: ["Breathing the vapour may bring on headache.", "No eating or smoking in the tool crib"],
        1013: ["Keep away from mist while working in the mixing bay."], 1014: ["Breathing the mist may bring on headache."], 1015: ["Breathing the mist may bring on headache."],
    }


def test_page_text_inside_a_line(table):
    inner = [
        (2001, "scan", ["Keep away from mist while SAFETY SHEET Foobar 12 Page 3/8 working in the tool crib."]), (2002, "scan", ["Breathing the fume 물질안전보건자료 루미파이로 10 (S2) 2/2 may bring on headache."]),
        (2003, "scan", ["H211 Leaves a film on floors in the drum store after - printed copy - p. 5 7 hours."]), (2004, "scan", ["Breathing the fume 4 / 4 페이지 may bring on headache. Keep away from spray while working in the mixing bay."]),
        (2005, "clean", ["Leaves a film on floors in the mixing bay after 7 hours."]),
    ]
    more = table.sparkSession.createDataFrame(inner, "k long, src string, h array<string>").withColumn("item_no", F.lit("clash"))
    rows = scans.clean_statements(table.unionByName(more), "k", fields()).where("k > 2000").collect()
    assert {(r.k, r.statement) for r in rows} == {
        (2001, "Keep away from mist while working in the tool crib."), (2002, "Breathing the fume may bring on headache."), (2003, "H211 Leaves a film on floors in the drum store after 7 hours."),
        (2004, "Breathing the fume may bring on headache. Keep away from spray while working in the mixing bay."), (2005, "Leaves a film on floors in the mixing bay after 7 hours."),
    }


def test_empty_tables(table):
    none = table.limit(0)
    assert truncation.find_truncated(none, "k", "src", fields()).count() == 0
    assert scans.find_damaged(none, "k", fields()).count() == 0
    assert scans.clean_statements(none, "k", fields()).count() == 0


def test_length_hazards(spark):
    random.seed(1)
    lengths = [min(80, random.randint(20, 120)) for _ in range(4000)]
    df = spark.createDataFrame([("s", n) for n in lengths] + [("t", None)], "src string, n int")
    got = truncation.length_hazards(df, ["src"], "n")
    assert [r.length for r in got.where("significant").collect()] == [80]
    assert got.where("src = 't'").count() == 0


def test_rates(spark):
    found = spark.createDataFrame([("s", "h", True), ("s", "h", False)], "src string, field_name string, significant boolean")
    totals = spark.createDataFrame([("s", "h", 10), ("t", "h", 5)], "src string, field_name string, n_items long")
    assert {r.src: (r.n_cut, r.share, r.at_limits) for r in truncation.source_rates(found, totals, "src").collect()} == {"s": (2, 0.2, 1), "t": (0, 0.0, 0)}


def test_tokens():
    assert statements.tokens("a - b well-known 2.. x") == ["a", " - ", "b", "well", "-", "known", "2", "..", "x"]
    assert statements.sentences(statements.tokens("A b. C 0.0 d")) == [["A", "b", "."], ["C", "0", ".", "0", "d"]]
