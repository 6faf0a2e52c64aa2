"""Variant spellings of company names, linked.

Method: a trie join. Names are reduced to a trade and a proper name; proper names become strings over letters (Hangul
also over its letters, the jamo), one string for every order of their words. The strings are sharded by trade and by
the parts of which one must be equal if two strings are within the bound, each shard is put into a trie, and the trie
is traversed with a Levenshtein automaton for every string of the shard, so all neighbours within the bound are
enumerated and nothing else is compared.

Words that say what a company does are taken from a dictionary of synonyms, a parameter, and beyond it from the names
themselves: a word that ends the names of many different companies is a trade of its own. A name whose trade is
unknown is indexed and linked like any other. Short names are compared too; a link between them needs a witness, which
is another value, such as the catalogue entry, under which both spellings occur.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialworks.session import checkpoint

#: What companies do, in Korean and English. Words of one line name the same trade; written together.
TRADES = {
    "trading": "상사 무역 트레이딩 트레이딩하우스 trading tradinghouse",
    "chemical": "케미칼 케미컬 화학 화학공업 켐 chemical chemicals chem chems",
    "coating": "코팅 코오팅 코팅스 coating coatings coat",
    "paint": "페인트 도료 페인트공업 paint paints",
    "adhesive": "접착제 본드 어드히시브 adhesive adhesives",
    "lubricant": "윤활유 루브 루브리컨트 루브리컨츠 lubricant lubricants lube",
    "welding": "용접재료 용접 용접봉 웰딩 welding weldingmaterials",
    "gas": "산업가스 가스 가스산업 gas gases industrialgas industrialgases",
    "plastic": "플라스틱 수지 합성수지 plastic plastics resin resins polymer polymers",
    "rubber": "고무 고무공업 rubber rubbers",
    "steel": "철강 제강 특수강 steel steels",
    "machinery": "기계 기계공업 중공업 machinery machine machines",
    "electronics": "전자 전자공업 일렉트로닉스 electronics electronic",
    "pharma": "제약 약품 파마 pharma pharmaceutical pharmaceuticals",
    "energy": "에너지 정유 energy petroleum oil",
    "textile": "섬유 방직 텍스타일 textile textiles",
}
#: Usual abbreviations of such words.
SHORT_FORMS = {"trdg": "trading", "pnt": "paint", "adhes": "adhesives", "lubric": "lubricant", "weld": "welding", "indl": "industrial", "ind": "industrial", "mfg": "manufacturing", "elec": "electronics", "mach": "machinery"}
#: Legal forms, offices and fillers that name no company.
FILLERS = (
    "㈜ (주) （주） (유) 주식회사 유한회사 (대리점) 대리점 본사 지사 지점 영업부 영업소 기술연구소 연구소 사무소 공장 코리아 "
    "co ltd inc corp corporation limited company llc gmbh korea headoffice branch agency plant"
)
STAND_INS = {"", "-", "--", "n/a", "na", "none", "null", "unknown", "tbd", "미상", "미정", "없음", "해당없음", "자료없음", "확인중", "?", "x", "xxx", "#n/a", "#ref!", "#value!"}

_LEADS = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
_TAILS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()
_TRADE_OF = {w: t for t, ws in TRADES.items() for w in ws.split()}
_TRADE_OF |= {a: _TRADE_OF[b] for a, b in SHORT_FORMS.items() if b in _TRADE_OF}
_TRADE_WORDS = sorted(_TRADE_OF, key=len, reverse=True)
_LATIN_FILLERS = {w for w in FILLERS.split() if w.isascii() and w.isalpha()}
_KOREAN_FILLERS = sorted((w for w in FILLERS.split() if not (w.isascii() and w.isalpha())), key=len, reverse=True)
_KOREAN_MARKS = re.compile("|".join(re.escape(w) for w in _KOREAN_FILLERS if not w.isalpha()) + "|주식회사|유한회사")


def romanise(text: str) -> str:
    """Hangul syllable by syllable in the Revised Romanization, without sound changes; other characters as they are."""
    out = []
    for ch in text:
        k = ord(ch) - 0xAC00
        if 0 <= k < 11172:
            out.append(_LEADS[k // 588].strip("-") + _VOWELS[k % 588 // 28] + _TAILS[k % 28].strip("-"))
        else:
            out.append(ch)
    return "".join(out)


def jamo(text: str) -> str:
    """Hangul as its letters, one character each."""
    return unicodedata.normalize("NFD", text)


@lru_cache(1)
def _trade_trie() -> Trie:
    trie = Trie()
    for w in _TRADE_OF:
        if len(w) >= 6 or (not w.isascii() and len(w) >= 3):
            trie.add(jamo(w))
    return trie


def _misspelt_trade(word: str) -> str:
    """The trade of a word that is one edit from a long enough word of a trade; '' if there is none or more than one."""
    if len(word) < 6 and (word.isascii() or len(word) < 3):
        return ""
    found = {_TRADE_OF[unicodedata.normalize("NFC", w)] for w in _trade_trie().near(jamo(word), 1)}
    return found.pop() if len(found) == 1 else ""


@lru_cache(1 << 16)
def read_name(name: str | None) -> tuple[str, tuple[str, ...]] | None:
    """(trade or '', words of the proper name in lower case); None for stand-ins and names of fillers only."""
    text = unicodedata.normalize("NFC", name or "").strip().lower()
    if re.sub(r"\s+", "", text) in STAND_INS:
        return None
    text = unicodedata.normalize("NFKC", _KOREAN_MARKS.sub(" ", text))
    text = re.sub(r"(?<!\S)제?\s*\d+\s*공장|(?<!\S)제?\d+(?=\s|$)", " ", text)
    words = [w for w in re.split(r"[\s.,;:/|·()\[\]\"'_-]+", text) if w and w not in _LATIN_FILLERS and w not in _KOREAN_FILLERS]
    trade = ""
    for n in (2, 1):  # a trade in words of its own
        for i in range(len(words) - n + 1):
            w = "".join(SHORT_FORMS.get(x, x) for x in words[i : i + n])
            if w in _TRADE_OF and len(words) > n:
                trade, words = _TRADE_OF[w], words[:i] + words[i + n :]
                break
        if trade:
            break
    if not trade and words:  # a trade written together with the proper name
        total = sum(map(len, words))
        for w in _TRADE_WORDS:
            least = 4 if w.isascii() else 2
            if total < len(w) + least:
                continue
            if words[-1].endswith(w):
                trade, words = _TRADE_OF[w], [*words[:-1], words[-1][: -len(w)]]
            elif words[0].startswith(w) and len(w) > (3 if w.isascii() else 1):
                trade, words = _TRADE_OF[w], [words[0][len(w) :], *words[1:]]
            if trade:
                words = [x for x in words if x]
                break
    if not trade and len(words) > 1:  # a trade with a typo, at either end
        for i in (len(words) - 1, 0):
            trade = _misspelt_trade(words[i])
            if trade:
                words = words[:i] + words[i + 1 :]
                break
    return (trade, tuple(words)) if words else None


def orders(words: list[str] | tuple[str, ...]) -> list[str]:
    """The words joined in the orders in which people write them: all of up to three, of more the sorted one and all
    rotations."""
    if len(words) == 1:
        return [words[0]]
    if len(words) <= 3:
        return list(dict.fromkeys("".join(p) for p in permutations(words)))
    return list(dict.fromkeys("".join(p) for p in (*([*words[i:], *words[:i]] for i in range(len(words))), sorted(words))))


def bound(text: str, syllables: int) -> int:
    """The edits allowed between a proper name and a spelling of it without a witness: none for short ones, which
    abbreviations and other short names resemble."""
    if syllables:
        return 2 if syllables >= 3 else 0
    return 2 if len(text) >= 10 else 1 if len(text) >= 8 else 0


class Trie:
    """Strings in a trie, searched with a Levenshtein automaton that also knows swapped neighbours."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: str) -> None:
        node = self.root
        for ch in text:
            node = node.setdefault(ch, {})
        node[""] = text

    def near(self, text: str, k: int) -> list[str]:
        """All strings of the trie within k edits of `text`; the state is the last two rows of the edit matrix."""
        n = len(text)
        found: list[str] = []
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, before, row, older = stack.pop()
            if "" in node and row[n] <= k:
                found.append(node[""])
            for ch, child in node.items():
                if not ch:
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (text[j - 1] != ch))
                    if older is not None and j > 1 and text[j - 2] == ch and text[j - 1] == before:
                        v = min(v, older[j - 2] + 1)
                    new.append(v)
                if min(new) <= k or min(row) < k:
                    stack.append((child, ch, new, row))
        return found


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the 2k + 1 parts of a string of length n; an edit, a swap too, touches at most two."""
    m = 2 * k + 1
    size, more = divmod(n, m)
    out, at = [], 0
    for i in range(m):
        length = size + (i < more)
        out.append((at, length))
        at += length
    return out


def shard_keys(text: str, k: int, query: bool) -> set[str]:
    """The shards a string is indexed in, or those in which a query must look. Strings too short to be parted share
    one shard for their length."""
    n, out = len(text), set()
    for length in range(max(0, n - k), n + k + 1) if query else (n,):
        if length < 2 * k + 1:
            out.add(f"{k}.{length}.s.")
            continue
        for i, (at, size) in enumerate(_segments(length, k)):
            for shift in range(-k, k + 1) if query else (0,):
                a = at + shift
                if a >= 0 and a + size <= n:
                    out.add(f"{k}.{length}.{i}.{text[a : a + size]}")
    return out


BLOCK = 4000


def trie_join(strings: DataFrame) -> DataFrame:
    """(grp, a, b): all pairs of different strings of a group within the bound, each once, a < b.

    strings: (grp, text, k, queries), text unique in its group; a string that doesn't query is only found. Two strings
    are compared under the smaller of their bounds; with a bound of 0 only equal strings would match, so none do.
    Large shards are split into blocks of index strings and of queries, so no task holds an unbounded shard. A shard is
    left out only if its one index string is also the one that queries it. Sides: 0 index string, 1 query that the
    shard has as an index string too, 2 query that it hasn't.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g, t, k, queries in zip(pdf.grp, pdf.text, pdf.k, pdf.queries, strict=True):
                for b in range(1, k + 1):
                    own = shard_keys(t, b, False)
                    rows += [(f"{len(g)}|{g}{s}", 0, t, k) for s in own]
                    if queries:
                        rows += [(f"{len(g)}|{g}{s}", 1 if s in own else 2, t, k) for s in shard_keys(t, b, True)]
            yield pd.DataFrame(rows, columns=["shard", "side", "text", "k"])

    rows = strings.where("k > 0").mapInPandas(emit, "shard string, side int, text string, k int")
    count = lambda c: F.sum(c.cast("long"))
    sizes = rows.groupBy("shard").agg(count(F.col("side") == 0).alias("index"), count(F.col("side") > 0).alias("query"), count(F.col("side") == 2).alias("other")).where("index > 0 and query > 0 and (index > 1 or other > 0)")
    sizes = sizes.select("shard", F.ceil(F.col("index") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("query") / BLOCK).cast("int").alias("nq"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    mine = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.struct((h % F.col("ni")).cast("int").alias("ib"), q.alias("qb")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("ib"), (h % F.col("nq")).cast("int").alias("qb")))
    )
    blocks = rows.join(sizes, "shard").select("shard", F.explode(mine).alias("b"), "side", "text", "k").select("shard", "b.ib", "b.qb", "side", "text", "k")
    runs = blocks.repartition("shard", "ib", "qb").sortWithinPartitions("shard", "ib", "qb", "side")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, trie, bounds = None, Trie(), {}
        seen: set[tuple[str, str, str]] = set()
        for pdf in batches:
            for shard, ib, qb, side, text, k in zip(pdf.shard, pdf.ib, pdf.qb, pdf.side, pdf.text, pdf.k, strict=True):
                if (shard, ib, qb) != run:
                    run, trie, bounds = (shard, ib, qb), Trie(), {}
                    size, _, rest = shard.partition("|")
                    grp, level = rest[: int(size)], int(rest[int(size) :].split(".", 1)[0])
                if side == 0:
                    trie.add(text)
                    bounds[text] = k
                elif bounds and (len(bounds) > 1 or text not in bounds):
                    for other in trie.near(text, level):
                        if other != text and min(k, bounds[other]) >= level:
                            seen.add((grp, *sorted((text, other))))
            yield pd.DataFrame(list(seen), columns=["grp", "a", "b"])
            seen.clear()

    return runs.mapInPandas(search, "grp string, a string, b string").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): the least node of the component of every node. edges: (a, b); nodes: (node), with all ends of edges.

    Least labels travel along the edges and jump to their labels' labels, so the rounds grow with the logarithm of
    the longest path; each round is cut off by a reliable checkpoint. It ends when a round changes no label, which it
    must, as labels only fall. Every node is a neighbour of itself, so a round is the join of edges and labels, reduced,
    on both sides of another join; the first needs only the latter. Plans cost the driver memory, so they are kept small.
    """
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).union(own).distinct())
    met = both.withColumn("comp", F.col("b"))
    while True:
        step = met.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("next"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("comp"))
        roots = step.select(F.col("node").alias("__n"), F.col("next").alias("__c"))
        step = checkpoint(step.join(roots, step.next == F.col("__n")).select("node", F.least("next", "__c").alias("next"), "comp"))
        labels = step.select("node", F.col("next").alias("comp"))
        if step.where("next <> comp").limit(1).isEmpty():
            return labels
        met = both.join(labels, both.b == labels.node).select("a", "b", "comp")


_WORDS = T.StructType([T.StructField("trade", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
_STRING = T.StructType([T.StructField("space", T.StringType()), T.StructField("text", T.StringType()), T.StructField("k", T.IntegerType())])
_FORMS = T.StructType(
    [T.StructField("roman", T.StringType()), T.StructField("syllables", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("strings", T.ArrayType(_STRING))]
)


@F.pandas_udf(_WORDS)
def _read(names: pd.Series) -> pd.DataFrame:
    got = [read_name(x) or (None, None) for x in names]
    return pd.DataFrame({"trade": [a for a, _ in got], "words": [None if b is None else list(b) for _, b in got]})


@F.pandas_udf(_FORMS)
def _forms(words: pd.Series) -> pd.DataFrame:
    """Of a proper name: its letters, its syllables if it is Hangul, its first two, and its strings with their bounds."""
    rows = []
    for ws in words:
        proper = "".join(ws)
        n = len(proper)
        syllables = n if all(0xAC00 <= ord(c) <= 0xD7A3 for c in proper) else 0
        strings = []
        for form in orders(list(ws)):
            roman = romanise(form)
            strings.append(("r", roman, 0 if 0 < syllables < 3 else bound(roman, 0)))
            if syllables:
                strings.append(("j", jamo(form), bound(form, syllables)))
        rows.append((romanise(proper), syllables, romanise(proper[:2]) if syllables >= 3 else None, strings))
    return pd.DataFrame(rows, columns=_FORMS.fieldNames()).astype({"syllables": "Int32"})


def learn_trades(read: DataFrame, min_rests: int = 30) -> DataFrame:
    """(word): words that end the names of many companies: those that stand beside at least `min_rests` different
    rests of names, mostly at the end. read: (name, words) of different names without a known trade."""
    w = read.where("size(words) > 1").select("words", F.posexplode("words").alias("pos", "word"))
    w = w.where(F.length("word") >= 2).select("word", F.array_join(F.array_remove("words", F.col("word")), " ").alias("rest"), (F.col("pos") == F.size("words") - 1).alias("last"))
    return w.groupBy("word").agg(F.countDistinct("rest").alias("rests"), F.avg(F.col("last").cast("int")).alias("share")).where((F.col("rests") >= min_rests) & (F.col("share") >= 0.5)).select("word")


def take_learned(read: DataFrame, learned: DataFrame) -> DataFrame:
    """(name, trade, words): with the last learned word of a name as its trade, also where it ends the last word of a
    name in Hangul. read: (name, words). A name never loses its only word."""
    n = F.size("words")
    own = read.select("name", F.posexplode("words").alias("pos", "word"), n.alias("n")).where("n > 1").select("name", "word", F.col("pos").alias("at"), F.lit(0).alias("cut"))
    tail = F.element_at("words", -1)
    glued = read.where(tail.rlike("^[가-힣]{4,}$")).select("name", n.alias("n"), tail.alias("t")).select("name", F.explode(F.expr("transform(sequence(2, length(t) - 2), k -> struct(right(t, k) as word, n - 1 as at, k as cut))")).alias("x")).select("name", "x.*")
    best = own.unionByName(glued).join(learned, "word").groupBy("name").agg(F.max(F.struct(F.when(F.col("cut") == 0, 1).otherwise(0).alias("whole"), F.col("at"), "cut", "word")).alias("b"))
    j = read.join(best, "name", "left")
    rest = F.when(F.col("b.whole") == 1, F.expr("filter(words, (x, i) -> i <> b.at)")).when(F.col("b").isNotNull(), F.expr("transform(words, (x, i) -> if(i = b.at, left(x, length(x) - b.cut), x))")).otherwise(F.col("words"))
    return j.select("name", F.coalesce(F.concat(F.lit("="), "b.word"), F.lit("")).alias("trade"), rest.alias("words"))


def link_names(names: DataFrame, name: str, witness: str | None = None, min_rests: int = 30) -> DataFrame:
    """(name, company): the class of every distinct name that isn't a stand-in; names of one company share it.

    witness: a column with values under which only one company occurs, such as an entry's key. Names too short for a
    bound of their own (Hangul of one or two syllables, less than eight letters) are linked over one edit where both
    occur under a common witness, else not.

    Defined results: null, blank and stand-in names give no row. Names without a trade are linked among themselves, and
    to the companies of a trade if they are near to one such company only; abbreviations (the first two syllables, or a
    beginning of four letters or more) likewise within their trade; otherwise they stay alone. Equal names count once.
    An empty table gives an empty result.
    """
    source = names.select(F.col(name).alias("name"), *([F.col(witness).alias("witness")] if witness else [])).where("name is not null")
    read = checkpoint(source.select("name").distinct().withColumn("p", _read("name")).where("p.words is not null").select("name", "p.*"))
    unknown = read.where("trade = ''").select("name", "words")
    named = read.where("trade <> ''").unionByName(take_learned(unknown, learn_trades(unknown, min_rests)))
    keyed = checkpoint(named.withColumn("f", _forms("words")).select("name", "trade", "f.*").withColumn("node", F.concat_ws("|", "trade", "roman")))
    keys = keyed.groupBy("node", "trade", "roman").agg(F.max("syllables").alias("syllables"))
    texts = checkpoint(keyed.select("node", "trade", F.explode("strings").alias("s")).groupBy("node", "trade", "s.space", "s.text").agg(F.max("s.k").alias("k")))
    # within a trade; names without one also look among the names of all trades
    by_text = texts.select(F.concat("space", F.lit(":"), "trade").alias("grp"), "text", "node", "k", F.lit(True).alias("queries"))
    across = texts.select(F.concat("space", F.lit("*")).alias("grp"), "text", "node", "k", (F.col("trade") == "").alias("queries"))
    strings = checkpoint(by_text.unionByName(across).groupBy("grp", "text").agg(F.max("k").alias("own"), F.max("queries").alias("queries")))
    near = trie_join(strings.select("grp", "text", F.greatest("own", F.lit(1)).alias("k"), "queries"))
    bounds = strings.select("grp", "text", F.col("own") == 0)
    weak = checkpoint(bounds.toDF("grp", "a", "wa").join(near, ["grp", "a"]).join(bounds.toDF("grp", "b", "wb"), ["grp", "b"]).select("grp", "a", "b", (F.col("wa") | F.col("wb")).alias("weak")))
    within = by_text.select("grp", "text", "node").distinct()
    pairs = checkpoint(
        weak.where(~F.substring("grp", 2, 1).eqNullSafe("*")).join(within.toDF("grp", "a", "na"), ["grp", "a"]).join(within.toDF("grp", "b", "nb"), ["grp", "b"])
        .where("na <> nb").groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.min("weak").alias("weak"))
    )
    same = within.join(within.groupBy("grp", "text").agg(F.min("node").alias("a")), ["grp", "text"]).where("node <> a").select("a", F.col("node").alias("b"))
    edges = pairs.where("not weak").select("a", "b").unionByName(same)
    if witness:
        seen = source.where("witness is not null").join(keyed.select("name", "node"), "name").select("node", "witness").distinct()
        open_pairs = pairs.where("weak").select("a", "b")
        edges = edges.unionByName(open_pairs.join(seen.toDF("a", "witness"), "a").join(seen.toDF("b", "witness"), ["b", "witness"]).select("a", "b").distinct())
    comp = components(edges, keys.select("node"))

    # a class without a trade: the one company of a trade that it is near to
    spread = across.select("grp", "text", "node").distinct()
    bare, full = spread.where("startswith(node, '|')").select("grp", F.col("text").alias("t"), F.col("node").alias("bare")), spread.where("not startswith(node, '|')")
    ends = weak.where("not weak and substring(grp, 2, 1) = '*'")
    ends = ends.select("grp", F.col("a").alias("t"), F.col("b").alias("text")).unionByName(ends.select("grp", F.col("b").alias("t"), F.col("a").alias("text"))).unionByName(bare.select("grp", "t", F.col("t").alias("text")).distinct())
    hits = ends.join(bare, ["grp", "t"]).join(full, ["grp", "text"]).select("bare", F.col("node").alias("full")).distinct()
    owner = lambda a, b: comp.select(F.col("node").alias(a), F.col("comp").alias(b))
    met = checkpoint(hits.join(owner("bare", "of"), "bare").join(owner("full", "target"), "full").groupBy("of").agg(F.min("target").alias("lo"), F.max("target").alias("hi")).where("lo = hi").select("of", F.col("lo").alias("to")))

    # abbreviations: the first two syllables, or a beginning, of one company of the trade only
    heads = keyed.where("head is not null and trade <> ''").select("trade", F.col("head").alias("roman"), F.col("node").alias("full")).distinct()
    short = keys.where("trade <> '' and syllables in (0, 2)")
    exact = short.join(heads, ["trade", "roman"]).where("node <> full").select("node", "full")
    stems = keys.where("trade <> '' and length(roman) >= 8").select("trade", F.col("node").alias("full"), F.explode(F.transform(F.sequence(F.lit(4), F.length("roman") - 4), lambda n: F.substring("roman", F.lit(1), n))).alias("roman"))
    loose = short.join(exact.select("node").distinct(), "node", "left_anti").join(stems, ["trade", "roman"]).where("node <> full").select("node", "full")
    abbreviated = exact.unionByName(loose).join(owner("full", "target"), "full").groupBy("node").agg(F.min("target").alias("lo"), F.max("target").alias("hi")).where("lo = hi").select("node", F.col("lo").alias("short_for"))
    final = comp.join(met, F.col("comp") == F.col("of"), "left").join(abbreviated, "node", "left").select("node", F.coalesce("short_for", "to", "comp").alias("company"))
    return checkpoint(keyed.join(final, "node").select("name", "company"))  # read several times; each would repeat this plan


def spelling_pairs(linked: DataFrame, block: int = 1_000) -> DataFrame:
    """(name_a, name_b): all pairs of different names of one company, name_a < name_b by code points.

    A company with more than `block` names is split: one side by hash into as many parts as it has blocks, the other
    side repeated for each, so no task holds all pairs of a company.
    """
    sizes = linked.groupBy("company").agg(F.ceil(F.count(F.lit(1)) / block).alias("salts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    s = linked.join(sizes, "company")
    a = s.select("company", F.expr("pmod(xxhash64(name), salts)").alias("salt"), F.col("name").alias("name_a"))
    b = s.select("company", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col("name").alias("name_b"))
    return a.join(b, ["company", "salt"]).where("name_a < name_b").select("name_a", "name_b")
