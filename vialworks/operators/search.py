"""Ranked search over catalogue entries: the query is read on the driver, rows are scored by three projections.

The first projection normalises every searched text once and joins the values of a field with line breaks, which no
normalised value holds, so "holds the term" and "equals the term" are plain substring tests inside generated code. The
second gives one flag for each rule and term, the third adds weights. Nothing is shuffled but the ingredient lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialworks.functions import keys, text

#: Groups of words that stand for each other in a search.
SYNONYMS = [
    ["신너", "신나", "시너", "thinner", "희석제", "solvent"],
    ["세정제", "세척제", "클리너", "크리너", "cleaner"],
    ["페인트", "도료", "paint", "coating"],
    ["경화제", "경화재", "hardener"],
    ["프라이머", "프라이마", "primer"],
    ["그리스", "구리스", "grease"],
    ["오일", "oil", "윤활유"],
    ["클리어", "clear"],
    ["그레이", "그래이", "gray", "grey"],
    ["블랙", "black"],
    ["화이트", "white"],
    ["실버", "silver"],
    ["락카", "라카", "lacquer"],
    ["우레탄", "urethane"],
]
#: What a match of each kind counts.
WEIGHTS = {
    "name_equal": 1200, "code_equal": 1100, "name_part": 800, "initials": 700, "file": 600, "erp": 500, "meta": 300, "component": 120, "detail": 60,
    "synonym": 220, "near": 160, "cas_equal": 350, "cas_part": 25, "hazard": 200,
}
_MARKS = re.compile(r"[\s()\[\]{}<>（）［］｛｝_\-/\\]")
_JAMO = re.compile("[ㄱ-ㅎ]")


def normal(s: str) -> str:
    return _MARKS.sub("", s.lower().replace(".pdf", ""))


def distance(a: str, b: str) -> int:
    """The number of edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass(frozen=True)
class Query:
    """A query as it is read: its tokens, its units (the whole and each other token), and what kind of query it is."""

    raw: str
    whole: str
    tokens: tuple[str, ...]
    units: tuple[tuple[str, bool], ...]
    initials: bool
    numeric: bool
    hazard: str
    cas: str
    digits: str
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    near: dict[str, tuple[str, ...]] = field(default_factory=dict)


def read_query(raw: str, synonyms: list[list[str]] = SYNONYMS) -> Query:
    """A token without digits and of two letters or more also stands for its whole group of synonyms, and in Korean for
    the words of other groups that are one edit away."""
    raw = raw.strip()
    whole = normal(raw)
    tokens = tuple(dict.fromkeys(t for t in (normal(x) for x in re.split(r"[\s,;]+", raw)) if t)) or ((whole,) if whole else ())
    groups = [[w for w in map(normal, g) if w] for g in synonyms]
    terms = list(dict.fromkeys(w for g in groups for w in g))
    alike, near = {}, {}
    for t in tokens:
        if len(t) < 2 or re.search("[0-9]", t):
            continue
        alike[t] = tuple(dict.fromkeys(w for g in groups if t in g for w in g))
        if re.search("[가-힣]", t):
            near[t] = tuple(w for w in terms if w != t and re.search("[가-힣]", w) and w not in alike[t] and abs(len(w) - len(t)) <= 1 and distance(t, w) <= 1)
    code = re.sub(r"[^A-Z0-9]", "", raw.upper())
    bare = re.sub(r"\s", "", raw)
    return Query(
        raw, whole, tokens, ((whole, True), *((t, False) for t in tokens if t != whole)) if whole else (), bool(_JAMO.search(raw)), whole.isdigit() and whole.isascii(),
        code if re.fullmatch("[HP][0-9]{3}", code) else "", bare if re.fullmatch(r"\d{2,7}-\d{2}-\d", bare) else "", re.sub(r"\D", "", raw),
        {t: x for t, x in alike.items() if x}, {t: x for t, x in near.items() if x},
    )


def joined(*values: Column) -> Column:
    """Values as one text, each between line breaks; blank ones are left out."""
    return F.concat(F.lit("\n"), F.array_join(F.array_compact(F.array(*[F.nullif(v, F.lit("")) for v in values])), "\n"), F.lit("\n"))


def code_candidates(c: Column) -> Column:
    """Parts of a text that look like a product's code: letters, then digits, then more of both."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{1,10}\s*[-_./]?\s*[0-9]{1,8}(?:\s*[-_./]?\s*[A-Za-z0-9]{1,12})*"), F.lit(0)), lambda x: F.length(keys.search_key(x)) >= 2)


def hazard_codes(c: Column) -> Column:
    """Hazard and precaution codes in a text, also with blanks or a dash after the letter; distinct, in their order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?<![0-9A-Za-z_])[HP]\s*[-_]?\s*[0-9]{3}(?![0-9A-Za-z_])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")))


def searched(entries: DataFrame, ingredients: DataFrame, key: str = "row_no") -> DataFrame:
    """(key, name, and the searched texts) of every entry, normalised once. Ingredient lines belong to `key`."""
    n, c = keys.search_key, F.col
    parts = ingredients.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(n(F.nullif(F.trim("chemicalName"), F.lit(""))))), "\n").alias("__names"),
        F.array_join(F.sort_array(F.collect_set(F.regexp_replace("casNo", r"\s", ""))), "\n").alias("__cas"),
        F.array_join(F.sort_array(F.collect_set(text.initials(n(F.nullif(F.trim("chemicalName"), F.lit("")))))), "\n").alias("__initials"),
    )
    p = [c(f"precautionaryStatements.{x}") for x in ("prevention", "response", "storage", "disposal")]
    lists = F.concat_ws(" ", F.array_join("hazardStatements", " "), *[F.array_join(x, " ") for x in p])
    codes = F.transform(code_candidates(F.concat_ws(" ", "productName", "erpName", "fileName", "pdfPath")), n)
    between = lambda x: F.concat(F.lit("\n"), F.coalesce(x, F.lit("")), F.lit("\n"))
    return entries.join(parts, key, "left").select(
        key, "productName", joined(n(c("productName"))).alias("s_name"), F.concat(F.lit("\n"), F.array_join(codes, "\n"), F.lit("\n")).alias("s_code"),
        joined(text.initials(n(c("productName"))), text.initials(n(c("erpName")))).alias("s_initials"), between(c("__initials")).alias("s_part_initials"),
        joined(n(c("fileName")), n(keys.base_name(c("pdfPath")))).alias("s_file"), joined(n(c("erpName"))).alias("s_erp"),
        joined(n(c("useCategory")), n(c("siteLabel")), n(c("supplier"))).alias("s_meta"), between(c("__names")).alias("s_component"), between(c("__cas")).alias("s_cas"),
        joined(n(c("ppeSummary")), n(F.array_join("hazardStatements", " ")), n(F.array_join(F.flatten(F.array_compact(F.array(*p))), " "))).alias("s_detail"), hazard_codes(lists).alias("s_hazard"),
    )


def score(index: DataFrame, q: Query, key: str = "row_no") -> DataFrame:
    """(key, productName, score, matched, direct, exact, part, detail_only, reason) of the entries that answer a query.

    Weights add up over units and kinds. A unit that is the whole query counts for every token. reason: the first kind
    that matched, with the word it stands for where that isn't the query's. A query without a letter or digit gives no row.
    """
    has = lambda col, term: F.contains(F.col(col), F.lit(term))
    equal = lambda col, term: F.contains(F.col(col), F.lit(f"\n{term}\n"))
    rules: list[tuple[str, Column, frozenset[str], str]] = []  # kind, flag, tokens it counts for, label
    tests: list[Column] = []

    def add(kind: str, cond: Column, tokens: frozenset[str], label: str | None = None) -> None:
        name = f"r{len(tests)}"
        tests.append(F.coalesce(cond, F.lit(False)).alias(name))
        rules.append((kind, F.col(name), tokens, label or kind))

    for u, is_whole in q.units:
        tokens = frozenset(q.tokens) if is_whole else frozenset([u])
        add("name_equal", equal("s_name", u), tokens)
        add("code_equal", equal("s_code", u), tokens)
        add("name_part", has("s_name", u) | has("s_code", u), tokens)
        if q.initials:
            first = "".join(text.INITIALS[(ord(x) - 44032) // 588] if "가" <= x <= "힣" else x for x in u)
            add("initials", has("s_initials", first) | has("s_part_initials", first), tokens)
        add("file", has("s_file", u), tokens)
        add("erp", has("s_erp", u), tokens)
        add("meta", has("s_meta", u), tokens)
        if not q.numeric:
            add("component", has("s_component", u), tokens)
            if not q.hazard and len(u) >= 2:
                add("detail", has("s_detail", u), tokens)
    for t in q.tokens:
        for kind, words in (("synonym", q.synonyms.get(t, ())), ("near", q.near.get(t, ()))):
            if words:
                hit = lambda w: has("s_name", w) | has("s_erp", w) | has("s_file", w) | has("s_meta", w)
                add(kind, reduce(lambda a, b: a | b, map(hit, words)), frozenset([t]), kind)
    whole = frozenset([q.whole])
    digits = F.regexp_replace("s_cas", r"[^0-9\n]", "")
    if q.whole:
        same = equal("s_cas", q.cas) if q.cas else F.contains(digits, F.lit(f"\n{q.digits}\n")) if len(q.digits) >= 5 else F.lit(False)
        add("cas_equal", same, whole)
        add("cas_part", ~same & F.contains(digits, F.lit(q.digits)) if not q.numeric and len(q.digits) >= 5 else F.lit(False), whole)
    if q.hazard:
        add("hazard", F.array_contains("s_hazard", q.hazard), whole)
    if not rules:
        return index.limit(0).select(key, "productName", *[F.lit(0).alias(x) for x in ("score", "matched")], *[F.lit(False).alias(x) for x in ("direct", "exact", "part", "detail_only")], F.lit("").alias("reason"))
    flags = index.select(key, "productName", *tests)
    any_of = lambda kinds: reduce(lambda a, b: a | b, [f for k, f, _, _ in rules if k in kinds], F.lit(False))
    total = reduce(lambda a, b: a + b, [F.when(f, WEIGHTS[k]).otherwise(0) for k, f, _, _ in rules])
    counted = sorted({t for _, _, ts, _ in rules for t in ts})
    matched = reduce(lambda a, b: a + b, [F.when(reduce(lambda a, b: a | b, [f for _, f, ts, _ in rules if t in ts]), 1).otherwise(0) for t in counted])
    direct = any_of(("name_equal", "code_equal", "name_part", "initials", "file", "erp"))
    scored = flags.select(
        key, "productName", total.alias("score"), matched.alias("matched"), direct.alias("direct"), any_of(("name_equal", "code_equal", "cas_equal", "hazard")).alias("exact"),
        any_of(("name_part", "initials", "file", "erp", "meta", "component", "detail", "synonym", "near", "cas_part")).alias("part"),
        (~(direct | any_of(("meta", "synonym", "near")))).alias("detail_only"), F.coalesce(*[F.when(f, F.lit(label)) for _, f, _, label in rules]).alias("reason"),
    )
    return scored.where("score > 0")


def ranked(hits: DataFrame, q: Query, key: str = "row_no") -> DataFrame:
    """The hits in the order in which they are shown; names by code points, then the key."""
    first = [F.desc("matched")] if len(q.tokens) > 1 else []
    return hits.orderBy(*first, F.desc("score"), F.desc("direct"), F.desc("matched"), F.desc("exact"), F.desc("part"), "detail_only", F.coalesce("productName", F.lit("")), key)


def suggestion_pool(entries: DataFrame, ingredients: DataFrame, key: str = "row_no", most: int = 60) -> DataFrame:
    """(norm, shown, initials, n, weight): everything a search can be completed to.

    Types by weight: names 0, components 1, use, place and supplier 2, registry numbers 3. An entry counts each of its
    different values of a type once; values over `most` characters are left out. Shown is the spelling of the first entry.
    """
    t = lambda c: F.trim(F.col(c))
    own = entries.select(key, F.explode(F.array(*[F.struct(F.lit(w).alias("w"), t(c).alias("v")) for c, w in (("productName", 0), ("useCategory", 2), ("siteLabel", 2), ("supplier", 2))])).alias("x"))
    parts = ingredients.select(key, F.explode(F.array(F.struct(F.lit(1).alias("w"), t("chemicalName").alias("v")), F.struct(F.lit(3).alias("w"), t("casNo").alias("v")))).alias("x"))
    pool = own.unionByName(parts).select(key, "x.*").where(f"v <> '' and length(v) <= {most}").distinct()
    g = pool.groupBy(keys.search_key(F.col("v")).alias("norm")).agg(F.min_by("v", F.struct(key, "w", "v")).alias("shown"), F.count(F.lit(1)).alias("n"), F.min("w").alias("weight"))
    return g.where("norm <> ''").select("norm", "shown", text.initials(F.col("norm")).alias("initials"), "n", "weight")


def suggestions(pool: DataFrame, raw: str, most: int = 8) -> DataFrame:
    """The `most` best completions of what was typed: those that begin with it, then by type, frequency, length, text."""
    needle = normal(raw)
    by_initials = bool(_JAMO.search(raw))
    first = "".join(text.INITIALS[(ord(x) - 44032) // 588] if "가" <= x <= "힣" else x for x in needle)
    at = F.instr(F.col("initials"), F.lit(first)) if by_initials else F.instr(F.col("norm"), F.lit(needle))
    hits = pool.where(F.col("norm") != needle).withColumn("at", at).where("at > 0") if needle else pool.limit(0).withColumn("at", F.lit(0))
    return hits.orderBy(F.col("at") != 1, "weight", F.desc("n"), F.length("shown"), "shown").limit(most)
