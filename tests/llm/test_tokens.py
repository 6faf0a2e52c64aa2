import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vialworks.llm import bpe, packing, pieces

PATH = bpe.vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(PATH, limit=50)


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab 한글's1é!\t\n\r 　²힣中.-")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_equal_the_public_encoder(ours, public, text):
    assert ours.encode(text) == public.encode_ordinary(text)


def test_long_text_without_a_cut(ours, public):
    text = "가나다라" * 8000
    assert ours.encode(text) == public.encode_ordinary(text)


def test_every_row_once(spark, public):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "   "), (None, "한글 text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df, "doc_id", "text", PATH).collect()), key=str)
    assert got == sorted(((k or 0, public.encode_ordinary(t or "")) for k, t in rows), key=str)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df.where("doc_id > 1"), "doc_id", "text", PATH).collect()} == {2: 0, 3: 0, 4: 1 + len(public.encode_ordinary("   ")) - 1}


TEXTS = ["word " * 400, "하나의 문장이다. " * 200, "가나다" * 900, "a\n\nb" * 300, "short", "x" * 3000, "1.5 mg, " * 250, " " * 900 + "end", "\n" * 500]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 16), (64, 48), (128, 100), (512, 64), (512, 496)])
def test_pieces(ours, text, limit, overlap):
    got = pieces.cut(ours, text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, n, _ in got:
        assert n == ours.count(text[a:b]) <= limit
    for (a, b, _, _), (c, e, _, again) in zip(got, got[1:]):
        assert a < c <= b < e
        assert overlap <= again <= overlap + overlap // 2 + limit // 2 if overlap else c == b
    assert pieces.cut(ours, text, limit, overlap, only_oversized=True) == (got if len(got) > 1 else [])


def test_pieces_end_at_sentences(ours):
    text = "One two three four five six seven. " * 30
    assert all(text[:b].rstrip().endswith(".") for _, b, _, _ in pieces.cut(ours, text, 100, 10))


def test_pieces_start_at_sentences(ours):
    text = "One two three four five six seven. " * 30
    assert all(text[a:].lstrip().startswith("One") for a, _, _, _ in pieces.cut(ours, text, 100, 24))


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, "word " * 300), (2, None), (3, ""), (4, "short"), (1, "word " * 300)], "doc_id long, text string").selectExpr("*", "'x' as piece")
    got = pieces.split_texts(df, "doc_id", "text", PATH, 64, 8, only_oversized=True)
    assert {r.doc_id for r in got.collect()} == {1} and got.where("piece_no = 1").count() == 2
    assert pieces.split_texts(df, "doc_id", "text", PATH, 64).where("doc_id = 4").first().piece == "short"
    assert pieces.split_texts(df.limit(0), "doc_id", "text", PATH, 64).count() == 0


def test_plan_uses_every_item_once():
    random.seed(2)
    for _ in range(200):
        capacity = random.choice([5, 17, 64])
        counts = {s: random.randint(0, 9) for s in range(1, capacity + 1)}
        used = dict.fromkeys(counts, 0)
        bins = 0
        for pattern, times in packing.plan(counts, capacity):
            assert sum(pattern) <= capacity and times > 0
            bins += times
            for s in pattern:
                used[s] += times
        assert used == counts
        assert bins <= 1.25 * -(-sum(s * n for s, n in counts.items()) // capacity) + 2


def test_exact_complements():
    got = packing.plan({3: 1, 7: 1, 4: 2, 2: 1, 10: 1}, 10)
    assert sorted((sorted(p), n) for p, n in got) == [([2, 4, 4], 1), ([3, 7], 1), ([10], 1)]


def test_pack_in_many_runs(spark):
    df = spark.range(5000).selectExpr("id as k", "case when id % 3 = 0 then 40 else cast(id % 64 as int) end as n")
    got = packing.pack(df, "k", "n", 64, run=100)
    assert got.select("k").distinct().count() == got.count() == 5000
    load = got.groupBy("container_no").agg({"part_size": "sum"}).withColumnRenamed("sum(part_size)", "s")
    assert load.where("s > 64").count() == 0 and load.agg({"container_no": "max"}).first()[0] == load.count()
    assert load.agg({"s": "sum"}).first()[0] == df.agg({"n": "sum"}).first()[0]


def test_pack(spark):
    rows = [(1, 25), (2, 10), (3, 5), (4, 5), (5, 3), (6, 0), (7, None), (3, 5), (8, -1)]
    df = spark.createDataFrame(rows, "k long, n int").selectExpr("*", "'x' as part_size")
    got = packing.pack(df, "k", "n", 10).collect()
    assert len(got) == len(rows) + 2
    assert sorted((r.part_no, r.part_size) for r in got if r.k == 1) == [(1, 10), (2, 10), (3, 5)]
    load = {}
    for r in got:
        load[r.container_no] = load.get(r.container_no, 0) + r.part_size
    assert max(load.values()) <= 10 and set(load) == set(range(1, len(load) + 1)) and len(load) == 6
    assert packing.pack(df.limit(0), "k", "n", 10).count() == 0
