import random

import pytest

from vialworks.llm import names


def osa(a, b):
    """Edit distance with swapped neighbours, in full."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def near_words(n, seed):
    random.seed(seed)
    base = ["".join(random.choice("abcde") for _ in range(random.randint(8, 14))) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        w = list(random.choice(base))
        for _ in range(random.randint(1, 3)):
            i = random.randrange(len(w) - 1)
            kind = random.random()
            if kind < 0.3:
                w[i], w[i + 1] = w[i + 1], w[i]
            elif kind < 0.6:
                w[i] = random.choice("abcde")
            elif kind < 0.8:
                del w[i]
            else:
                w.insert(i, random.choice("abcde"))
        out.add("".join(w))
    return sorted(out)


def test_trie_search_is_brute_force():
    words = near_words(120, 3)
    trie = names.Trie()
    for w in words:
        trie.add(w)
    for w in words[::7]:
        for k in (0, 1, 2):
            assert sorted(trie.near(w, k)) == [x for x in words if osa(w, x) <= k]


def test_trie_join_is_brute_force(spark):
    words = near_words(160, 4)
    df = spark.createDataFrame([("g", w, 2, True) for w in words] + [("h", words[0], 2, True)], "grp string, text string, k int, queries boolean")
    got = {(r.a, r.b) for r in names.trie_join(df).where("grp = 'g'").collect()}
    assert got == {(a, b) for a in words for b in words if a < b and osa(a, b) <= 2}
    assert names.trie_join(df.limit(0)).count() == 0


def test_trie_join_finds_lone_strings_that_do_not_query(spark):
    """Shards of one index string and one query; strings of any length, also with the sign that ends a group's name."""
    random.seed(5)
    lone = [("g", "zorvanix", 1, False), ("g", "zorvanixx", 1, True), ("a|1", "ab|cd|ef", 2, False), ("a|1", "ab|cd|eff", 2, True), ("e", "", 1, False), ("e", "q", 1, True)]
    texts = {"".join(random.choice("ab|") for _ in range(random.randint(0, 9))) for _ in range(60)} | set(near_words(40, 11))
    rows = lone + [("m|2.", t, random.randint(1, 2), random.random() < 0.4) for t in sorted(texts)]
    got = [tuple(r) for r in names.trie_join(spark.createDataFrame(rows, "grp string, text string, k int, queries boolean")).collect()]
    want = {(g, a, b) for g, a, k, q in rows for h, b, m, p in rows if g == h and a < b and (q or p) and osa(a, b) <= min(k, m)}
    assert len(got) == len(set(got)) and set(got) == want and {x[0] for x in want} == {"g", "a|1", "e", "m|2."}


@pytest.mark.parametrize(
    ("name", "want"),
    [("㈜릴분붐콘상사", ("trading", ("릴분붐콘",))), ("Trading House, Rilbunbumkon Co.,Ltd", ("trading", ("rilbunbumkon",))), ("NaembamjaelnyeoChem. Co.,Ltd", ("chemical", ("naembamjaelnyeo",))),
     ("릴분 상사 제2공장", ("trading", ("릴분",))), ("㈜라공장숨상사", ("trading", ("라공장숨",))), ("가스산업 남컹김솜 (대리점)", ("gas", ("남컹김솜",))), ("Indl. Gas, Han Bit", ("gas", ("han", "bit"))),
     ("Rilbun Chemcial", ("chemical", ("rilbun",))), ("Zorvanix Bakery", ("", ("zorvanix", "bakery"))), ("N/A", None), ("  ", None), (None, None), ("미상", None), ("Co., Ltd.", None)],
)
def test_parts_of_a_name(name, want):
    assert names.read_name(name) == want


def test_romanisation():
    assert names.romanise("툰놈정패") == "tunnomjeongpae" and names.romanise("릴분 a") == "rilbun a"


def test_links(spark):
    one = ["㈜릴분붐콘상사", "릴분붐콩 무역", "Rilbunbumkon Trading Co., Ltd.", "rlibunbumkon trdg.", "릴분 트레이딩 본사", "Trading, Rilbun"]
    two = ["㈜릴분붐콘윤활유", "Rilbunbumkon Lube"]
    rest = ["㈜툰놈정패케미칼", "x" * 5000]
    df = spark.createDataFrame([(n,) for n in one + two + rest + ["unknown", "", None, one[0]]], "name string").selectExpr("name", "'y' as company")
    got = {r.name: r.company for r in names.link_names(df, "name").collect()}
    assert set(got) == set(one + two + rest)
    assert len({got[n] for n in one}) == 1 and len({got[n] for n in two}) == 1 and len(set(got.values())) == 4
    pairs = {(r.name_a, r.name_b) for r in names.spelling_pairs(names.link_names(df, "name")).collect()}
    assert pairs == {(a, b) for g in (one, two) for a in g for b in g if a < b}
    assert names.link_names(df.limit(0), "name").count() == 0


def linked(spark, rows, **more):
    df = spark.createDataFrame(rows, "name string, entry string")
    return {r.name: r.company for r in names.link_names(df, "name", witness="entry", **more).collect()}


def test_names_without_a_known_trade_and_reordered_words(spark):
    same = [["Zorvanix Bakery", "Zorvanixx Bakery", "Bakery Zorvanix Ltd."], ["Kimhanseo Pakdojin Trading", "Pakdojin Kimhanseo Trading Co.", "Trading, Pakdojin Kimhansoe"], ["Kimhanseo Pakdojin Foundry", "PAKDOJIN KIMHANSEO FOUNDRY"], ["한빛 누리 도서", "누리 한빛 도서"]]
    got = linked(spark, [(n, None) for g in same for n in g])
    for g in same:
        assert len({got[n] for n in g}) == 1, g
    assert len(set(got.values())) == 4


def test_name_without_a_trade_joins_the_one_company_near_to_it(spark):
    got = linked(spark, [("Zorvanix Trading", None), ("Zorvanixx", None), ("Kelimador Steel", None)])
    assert got["Zorvanix Trading"] == got["Zorvanixx"] != got["Kelimador Steel"]


def test_short_names_need_a_witness(spark):
    rows = [("한솔 무역", "e1"), ("한술 무역", "e1"), ("한살 무역", "e2"), ("Acmeko", "e3"), ("Acmek", "e3"), ("Acmoko", "e4"), ("LG", "e5"), ("LGG", "e5"), ("LS", "e6")]
    got = linked(spark, rows)
    assert got["한솔 무역"] == got["한술 무역"] != got["한살 무역"] and got["Acmeko"] == got["Acmek"] != got["Acmoko"] and got["LG"] == got["LGG"] != got["LS"]
    assert len(set(linked(spark, [(n, None) for n, _ in rows]).values())) == len(rows)


def words_of(n, seed, syllables):
    random.seed(seed)
    out = set()
    while len(out) < n:
        out.add("".join(random.choice("bdghjklmnprstvz") + random.choice("aeiou") for _ in range(syllables)))
    return sorted(out)


def test_learned_trades_part_near_proper_names(spark):
    proper = words_of(40, 6, 3)
    near = ("kalimo", "kalima")
    rows = [(f"{p} {t}", None) for p in proper for t in ("Bakery", "Brewery")] + [(f"{p} bakery", None) for p in near]
    got = linked(spark, rows, min_rests=20)
    assert len({got[f"{p} {t}"] for p in proper for t in ("Bakery", "Brewery")}) == 80  # a proper name with another trade is another company
    assert got["kalimo bakery"] != got["kalima bakery"]  # short without the learned trade, so a witness would be needed


def test_recall_on_held_out_names(spark):
    """Names of trades out of every list, with typos, reordered words, and short ones with a common entry."""
    random.seed(9)
    heads, tails = words_of(60, 7, 4), words_of(60, 8, 3)
    rows, truth = [], {}
    for i, (a, b) in enumerate(zip(heads, tails, strict=True)):
        base = f"{a} {b} {('Foundry', 'Bakery', 'Tannery')[i % 3]}"
        typo = list(base)
        k = random.randrange(1, len(a) - 1)
        typo[k], typo[k + 1] = typo[k + 1], typo[k]
        spellings = [base, "".join(typo), f"{b} {a} {base.split()[-1]} Co., Ltd.", base.upper()]
        short, entry = a[:6], f"e{i}"
        truth[i] = [spellings, [f"{short} {'상사'}", f"{short[:2]}{short[3:]} {'상사'}"]]
        rows += [(n, None) for n in spellings] + [(n, entry) for n in truth[i][1]]
    got = linked(spark, rows)
    pairs = [(a, b) for groups in truth.values() for g in groups for x, a in enumerate(g) for b in g[x + 1 :]]
    assert sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.9
    across = [(g[0][0], h[0][0]) for i, g in truth.items() for j, h in truth.items() if i < j]
    assert sum(got[a] == got[b] for a, b in across) / len(across) <= 0.01


def test_pairs_of_a_large_company_are_split(spark):
    df = spark.range(90).selectExpr("cast(id as string) as name", "'c' as company")
    assert names.spelling_pairs(df, block=20).distinct().count() == names.spelling_pairs(df, block=20).count() == 90 * 89 // 2


def test_plans_stay_small(spark, monkeypatch):
    """What is handed on is read several times, so it must not hold the plan of the links; a round has one join on both sides of another."""
    plans = []
    keep = names.checkpoint
    monkeypatch.setattr(names, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or keep(df))
    linked = names.link_names(spark.createDataFrame([("Zorvanix Trading",), ("Zorvanixx Trading",)], "name string"), "name")
    assert names.spelling_pairs(linked)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    plans.clear()
    nodes = spark.range(40).selectExpr("format_string('%02d', id) as node")
    chain = nodes.selectExpr("node as a", "format_string('%02d', int(node) + 1) as b").where("b < '40' and b <> '20'")
    assert {r.node: r.comp for r in names.components(chain, nodes).collect()} == {f"{i:02d}": "00" if i < 20 else "20" for i in range(40)}
    assert max(plans) <= 3 and len(plans) <= 9


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(c,) for c in "abcdexyz"], "node string")
    assert {r.node: r.comp for r in names.components(edges, nodes).collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x", "z": "z"}
