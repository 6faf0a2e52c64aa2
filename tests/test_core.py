import pytest
from pyspark.sql import functions as F

from vialworks.functions import keys, text
from vialworks.operators import catalogue as op
from vialworks.operators import profile
from vialworks.operators import segmentation
from vialworks.operators.segmentation import Dictionary, count_values, split_cell, split_values

NONE = Dictionary([])


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("a;b", [(1, "a"), (2, "b")]), ("a;;b;", [(1, "a"), (3, "b")]), ("a", []), ("a;", []), ("", []), (None, []), ("  ", []), ("a\r\nb", [(1, "a"), (2, "b")]),
        ("mask (A2/P3)/suit", [(1, "mask (A2/P3)"), (2, "suit")]), ('"x, 2 ea","y ""B""",z', [(1, "x, 2 ea"), (2, 'y "B"'), (3, "z")]), ('["a", "b, c"]', [(1, "a"), (2, "b, c")]),
        ("1) a 2) b", [(1, "a"), (2, "b")]), ("(1) a, (2) b", [(1, "a"), (2, "b")]), ("①a②b", [(1, "a"), (2, "b")]), ("• a • b", [(1, "a"), (2, "b")]), ("- a\n- b", [(1, "a"), (2, "b")]),
        ("Gate 2 031-555-0103; 02) 555 - 0180", [(1, "Gate 2 031-555-0103"), (2, "02) 555 - 0180")]), ("055-555-0165 041-555-0104  Desk (02) 555-0140", [(1, "055-555-0165"), (2, "041-555-0104"), (3, "Desk (02) 555-0140")]),
        ("a and b", []), ("a 및 b | c", [(1, "a 및 b"), (2, "c")]), ("a + b", [(1, "a"), (2, "b")]), ('"open, b', [(1, '"open'), (2, "b")]),
    ],
)
def test_cells(cell, want):
    assert split_cell(cell, NONE) == want


def test_known_values_protect_their_delimiters():
    known = Dictionary(["5/6 suit", "gloves", "mask"])
    assert split_cell("5/6 suit/gloves", known) == [(1, "5/6 suit"), (2, "gloves")]
    assert split_cell("gloves mask", known) == [(1, "gloves"), (2, "mask")]


def test_learned_values(spark):
    rows = [(i, '["5/6 suit", "cap"]') for i in range(5)] + [(9, "5/6 suit/cap"), (10, None), (11, "")]
    df = spark.createDataFrame(rows, "row_no long, f string").withColumn("item_no", F.lit("clash"))
    assert sorted(r.item_value for r in count_values(df, ["f"]).collect()) == ["5/6 suit", "cap"]
    assert [(r.item_no, r.item_value) for r in split_values(df, "row_no", ["f"]).where("row_no = 9").orderBy("item_no").collect()] == [(1, "5/6 suit"), (2, "cap")]
    assert split_values(df.limit(0), "row_no", ["f"]).count() == 0


def test_profile(spark):
    rows = [(1, "AB-1"), (1, "AB-2"), (1, "x"), (1, None), (2, "  "), (2, None), (2, "AB-3"), (2, "AB-3"), (None, "q"), (3, None)]
    df = spark.createDataFrame(rows, "load_no int, v string").withColumn("n", F.lit(0))
    counts = profile.mask_counts(df, "load_no", ["v"])
    assert {(r.load_no, r["mask"]): r.n for r in counts.collect()} == {(1, "AA-9"): 2, (1, "a"): 1, (1, None): 1, (2, None): 2, (2, "AA-9"): 2, (None, "a"): 1, (3, None): 1}
    figures = profile.load_figures(counts, {"v": profile.mask_form("^[A-Z]{2}-[0-9]$")})
    got = {r.load_no: (r.blank, r.distinct, r.pattern, r.length) for r in figures.collect()}
    assert got[2] == (0.5, 0.5, 0.0, 4.0) and got[1] == (0.25, 1.0, 1 / 3, 3.0) and got[3] == (1.0, None, None, None)
    assert {(r.load_no, r.figure) for r in profile.changed_figures(figures).collect()} == {(2, "blank"), (2, "distinct"), (2, "pattern"), (2, "length"), (3, "blank")}
    assert profile.changed_figures(profile.load_figures(profile.mask_counts(df.limit(0), "load_no", ["v"]), {})).count() == 0
    assert profile.mask_divergence(counts).where("load_no = 2").first().divergence > 0
    assert profile.mask_report(counts).where("is_violation").count() == 0


def test_registry_numbers(spark):
    df = spark.createDataFrame([(c,) for c in ("67-64-1", "107-07-3", "1330-20-7", "2028-08-3", "2028-08-30", "67-64-10", "x67-64-1", "", None)], "c string")
    assert [r.v for r in df.select(text.valid_cas(F.col("c")).alias("v")).collect()] == [True] * 3 + [False] * 6
    df = spark.createDataFrame([("T-2023-00604(2028-08-30) 67-64-1 2028-08-3",), ("x67-64-1 67-64-10",)], "t string")
    assert [r.v for r in df.select(text.extract_cas(F.col("t")).alias("v")).collect()] == [["67-64-1"], []]


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(text.initials(F.lit("프라이머 A"))).first()[0] == "ㅍㄹㅇㅁ a"
    assert one.select(text.bigram_similarity(F.lit("a"), F.lit("abc"))).first()[0] == 0.0
    assert one.select(text.pictograms(F.array(F.lit("flame"), F.lit("GHS02"), F.lit("skull"), F.lit("?")))).first()[0] == ["GHS02", "GHS06"]
    need = lambda *h: one.select(text.required_pictograms(F.array(*map(F.lit, h)))).first()[0]
    assert need("H301", "H302") == ["GHS06"] and need("H314", "H315") == ["GHS05"] and need("H315") == ["GHS07"] and need("H334", "H317") == ["GHS08"]
    assert [one.select(text.csv_cell(F.lit(v))).first()[0] for v in ("=1", 'a"b', "x", None)] == ["'=1", '"a""b"', "x", ""]
    assert one.select(keys.search_key(F.lit("A (b)-C_1.PDF"))).first()[0] == "abc1"
    assert one.select(keys.pdf_path(F.lit("/x/y.pdf"))).first()[0] == "pdf/x/y.pdf"


def test_priority_join_is_the_nested_loop(spark):
    import random

    random.seed(1)
    left = [(i, random.choice(["a", "b", "", None]), random.choice(["x", "y", "z"])) for i in range(40)]
    right = [(i, random.choice(["a", "c", None]), random.choice(["x", "q", ""])) for i in range(12)]
    want = {}
    for i, a, b in left:
        for kind, v, k in (("a", a, 1), ("b", b, 2)):
            hit = min((r[0] for r in right if v and r[k] == v), default=None)
            if hit is not None:
                want[i] = (hit, kind)
                break
    lf, rf = spark.createDataFrame(left, "i int, a string, b string"), spark.createDataFrame(right, "j int, a string, b string")
    got = op.priority_join(lf, "i", [("a", F.col("a")), ("b", F.col("b"))], rf, "j", [("a", F.col("a")), ("b", F.col("b"))])
    assert {r.i: (r.j, r.matched_by) for r in got.collect()} == want


def test_diff_patch_and_elections(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "7")], "p string, d string")
    assert {r.p: r.status for r in op.snapshot_diff(old, new, "p", "d").collect()} == {
        "a": "unchanged", "b": "changed_same_path", "c": "deleted_from_source", "x": "moved_or_renamed_candidate", "y": "new_file"
    }
    patched = op.guarded_patch(old, "p", "d", spark.createDataFrame([("a", "1", "one"), ("b", "x", "no")], "key string, before string, after string"))
    assert {r.p: (r.d, r.patched) for r in patched.collect()} == {"a": ("one", True), "b": ("2", False), "c": ("3", False)}
    assert op.elect(old, F.lit(1), [-F.col("d").cast("int"), F.col("p")], ["p"]).first().p == "c"
    assert {r.value: r.n for r in op.count_by_vocabulary(old, "p", ["a", "q"]).collect()} == {"a": 1, "q": 0}
    a, b = op.library_fingerprint(old, "p", "d").first(), op.library_fingerprint(old.orderBy(F.desc("p")), "p", "d").first()
    assert a == b and a.files == 3 and a != op.library_fingerprint(new, "p", "d").first()


def test_search(spark):
    from vialworks.operators import search

    rows = [(1, "크릴 신너 100", "ERP A", "a.pdf", None, None, None), (2, "주방 세정제", None, "크릴.pdf", None, None, None), (3, "Foo", None, None, ["H315 x"], "장갑", None), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_no long, productName string, erpName string, fileName string, hazardStatements array<string>, ppeSummary string, pdfPath string").selectExpr(
        "*", "cast(null as string) useCategory", "cast(null as string) siteLabel", "cast(null as string) supplier", "named_struct('prevention', array('P280 x'), 'response', array(), 'storage', cast(null as array<string>), 'disposal', array()) precautionaryStatements", "'clash' as score"
    )
    lines = spark.createDataFrame([(1, "Xylene", "1330-20-7"), (1, None, None), (3, "Xylene", " 1330-20-7")], "row_no long, chemicalName string, casNo string")
    index = search.searched(df, lines)
    go = lambda t: {r.row_no: (r.score, r.reason) for r in search.score(index, search.read_query(t)).collect()}
    assert go("크릴") == {1: (800, "name_part"), 2: (600, "file")} and go("thinner")[1] == (220, "synonym") and go("xylene") == {1: (120, "component"), 3: (120, "component")}
    assert go("1330-20-7") == {1: (350, "cas_equal"), 3: (350, "cas_equal")} and go("h315") == {3: (200, "hazard")} and go("장갑") == {3: (60, "detail")} and go("ㅋㄹㅅㄴ")[1] == (700, "initials")
    assert go(" ") == {} and search.score(index.limit(0), search.read_query("a")).count() == 0


def test_lookalikes_against_pairs(spark):
    names = ["abcdefgh", "abcdefxyz", "abcdefgh", "abc", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop", "abcdefghijklmnopqrstuvwxyzab", None, "zzzzzzzz"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    ok = [(i, n) for i, n in enumerate(names) if n and len(n) >= 6]
    want = {i: sum(i != j and common(a, b) >= max(6, 0.3 * min(len(a), len(b))) for j, b in ok) for i, a in ok}
    assert {r.k: r.partners for r in op.lookalikes(df, "k", "n").collect()} == {i: n for i, n in want.items() if n}


def test_precautions_of_all_lists(spark, tmp_path):
    import __spark_entry__ as e

    row = (["P210 a", "b", None], ["P301 c", "P210 d"], ["P403 e"], ["P501 f", "P501 g"])
    df = spark.createDataFrame([(row,), (None,), ((None, [], None, ["h"]),)], "precautionaryStatements struct<prevention array<string>, response array<string>, storage array<string>, disposal array<string>>")
    df.write.parquet(f"{tmp_path}/msds_sample.parquet")
    assert {(r.list, r.grp): r.n for r in e.queries()["rul8_precaution_groups"](spark, str(tmp_path)).collect()} == {
        ("prevention", "prevention"): 1, ("prevention", "none"): 1, ("response", "response"): 1, ("response", "prevention"): 1, ("storage", "storage"): 1, ("disposal", "disposal"): 2, ("disposal", "none"): 1
    }


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert {"p1_found", "p4_found", "p5_found", "agg1_substances"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_rare_known_values_are_protected_without_a_broadcast(spark):
    rows = [(1, '["gloves, long", "mask"]'), (2, '["gloves, long", "boots"]'), (3, '["gloves, long", "hood"]'), (4, "gloves, long, mask, apron"), (5, "mask"), (6, None), (7, ""), (8, "mask, , hood")]
    df = spark.createDataFrame(rows, "k long, v string").selectExpr("*", "'clash' as item_no")
    by_broadcast = {(r.k, r.item_no, r.item_value) for r in segmentation.split_values(df, "k", ["v"], min_rows=1).collect()}
    by_join = {(r.k, r.item_no, r.item_value) for r in segmentation.split_values(df, "k", ["v"], min_rows=1, most=0).collect()}
    assert by_join == by_broadcast and {(4, 1, "gloves, long"), (4, 2, "mask"), (4, 3, "apron"), (8, 1, "mask"), (8, 3, "hood")} <= by_join
    assert segmentation.split_values(df.limit(0), "k", ["v"], most=0).count() == 0
