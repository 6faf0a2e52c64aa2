"""Search queries over a catalogue folder, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.functions import keys, text
from vialworks.operators import search as op
from vialworks.plans.catalogue import _BASE, _SEARCH, query
from vialworks.sources.tables import table

ASKED = ["크릴 thinner", "ㅋㄹ", "H315", "1330-20-7", "신나", "2 hardener", "  "]
_INITIALS = """array_to_string(list_transform(string_split({c}, ''), lambda x: case when x between '가' and '힣'
  then substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', cast(floor((unicode(x) - 44032) / 588) as int) + 1, 1) else x end), '')"""
_CODE = r"[A-Za-z]{1,10}\s*[-_./]?\s*[0-9]{1,8}(?:\s*[-_./]?\s*[A-Za-z0-9]{1,12})*"
_P = ["prevention", "response", "storage", "disposal"]
_LIST = lambda c: f"coalesce(array_to_string(list_filter({c}, lambda x: x is not null), ' '), '')"
_ALL_P = " || ' ' || ".join(_LIST(f"precautionaryStatements.{p}") for p in _P)
#: What is searched, as lists of normalised values.
_INDEX = f"""parts as (select row_no, list(distinct {_SEARCH("nullif(trim(chemicalName), '')")}) as comps, list(distinct regexp_replace(casNo, '\\s', '', 'g')) as cas from msds_ingredient group by row_no),
ix as (select s.row_no, productName, [{_SEARCH('productName')}] as names, list_transform(list_filter(regexp_extract_all(concat_ws(' ', productName, erpName, fileName, pdfPath), '{_CODE}'), lambda x: length({_SEARCH('x')}) >= 2), lambda x: {_SEARCH('x')}) as codes,
  [{_SEARCH('fileName')}, {_SEARCH(_BASE('pdfPath'))}] as files, [{_SEARCH('erpName')}] as erps, [{_SEARCH('useCategory')}, {_SEARCH('siteLabel')}, {_SEARCH('supplier')}] as metas,
  coalesce(comps, []) as comps, coalesce(cas, []) as cas, [{_SEARCH('ppeSummary')}, {_SEARCH(_LIST('hazardStatements'))}, {_SEARCH(_ALL_P)}] as details,
  list_transform(regexp_extract_all({_LIST('hazardStatements')} || ' ' || {_ALL_P}, '(?i)\\b[HP]\\s*[-_]?\\s*[0-9]{{3}}\\b'), lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')) as hazards
  from msds_sample s left join parts using (row_no))"""


def _scored_sql(raw: str) -> str:
    """The scoring of one query as SQL over the index."""
    q = op.read_query(raw)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda col, t: f"len(list_filter({col}, lambda x: contains(x, {quote(t)}))) > 0"
    equal = lambda col, t: f"list_contains({col}, {quote(t)})"
    rules: list[tuple[str, str, list[str]]] = []
    for u, is_whole in q.units:
        ts = list(q.tokens) if is_whole else [u]
        rules += [("name_equal", equal("names", u), ts), ("code_equal", equal("codes", u), ts), ("name_part", f"({has('names', u)} or {has('codes', u)})", ts)]
        if q.initials:
            rules.append(("initials", f"len(list_filter(list_concat(names, erps, comps), lambda x: contains({_INITIALS.format(c='x')}, {quote(u)}))) > 0", ts))
        rules += [("file", has("files", u), ts), ("erp", has("erps", u), ts), ("meta", has("metas", u), ts)]
        if not q.numeric:
            rules.append(("component", has("comps", u), ts))
            if not q.hazard and len(u) >= 2:
                rules.append(("detail", has("details", u), ts))
    for t in q.tokens:
        for kind, words in (("synonym", q.synonyms.get(t, ())), ("near", q.near.get(t, ()))):
            if words:
                rules.append((kind, "(" + " or ".join(has("list_concat(names, erps, files, metas)", w) for w in words) + ")", [t]))
    if q.whole:
        digits = "list_transform(cas, lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
        same = equal("cas", q.cas) if q.cas else equal(digits, q.digits) if len(q.digits) >= 5 else "false"
        rules.append(("cas_equal", same, [q.whole]))
        rules.append(("cas_part", f"(not coalesce({same}, false) and {has(digits, q.digits)})" if not q.numeric and len(q.digits) >= 5 else "false", [q.whole]))
    if q.hazard:
        rules.append(("hazard", equal("hazards", q.hazard), [q.whole]))
    if not rules:
        return "select null::varchar as query, row_no, productName, 0 as score, 0 as matched, false as direct, false as exact, false as part, false as detail_only, '' as reason from ix where false"
    flag = lambda i: f"r{i}"
    any_of = lambda kinds: "(" + (" or ".join(flag(i) for i, (k, _, _) in enumerate(rules) if k in kinds) or "false") + ")"
    direct = any_of(("name_equal", "code_equal", "name_part", "initials", "file", "erp"))
    counted = sorted({t for _, _, ts in rules for t in ts})
    matched = " + ".join("(" + " or ".join(flag(i) for i, (_, _, ts) in enumerate(rules) if t in ts) + ")::int" for t in counted)
    return f"""select {quote(raw)} as query, row_no, productName, {' + '.join(f'r{i}::int * {op.WEIGHTS[k]}' for i, (k, _, _) in enumerate(rules))} as score, {matched} as matched, {direct} as direct,
  {any_of(('name_equal', 'code_equal', 'cas_equal', 'hazard'))} as exact, {any_of(('name_part', 'initials', 'file', 'erp', 'meta', 'component', 'detail', 'synonym', 'near', 'cas_part'))} as part,
  not ({direct} or {any_of(('meta', 'synonym', 'near'))}) as detail_only, case {' '.join(f"when r{i} then '{k}'" for i, (k, _, _) in enumerate(rules))} end as reason
  from (select row_no, productName, {', '.join(f'coalesce({s}, false) as r{i}' for i, (_, s, _) in enumerate(rules))} from ix) where {' or '.join(flag(i) for i in range(len(rules)))}"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return op.searched(table(spark, d, "msds_sample"), table(spark, d, "msds_ingredient"))


@query(f"with {_INDEX} select * exclude (query) from ({_scored_sql(ASKED[0])})")
def top1_search(spark: SparkSession, d: str) -> DataFrame:
    """All answers to a query of two words, in the order in which they are shown."""
    q = op.read_query(ASKED[0])
    return op.ranked(op.score(_index(spark, d), q), q)


@query(f"with {_INDEX} select * from (" + " union all ".join(f"({_scored_sql(a)})" for a in ASKED) + ")")
def rul19_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of several kinds of query over one index: words, initials, a hazard code, a registry number, a synonym."""
    index = _index(spark, d)
    return reduce(DataFrame.unionByName, [op.score(index, op.read_query(a)).withColumn("query", F.lit(a)) for a in ASKED])


_ORDERED = f"with {_INDEX} select row_no, productName, score, row_number() over (order by @order) as place from ({_scored_sql('크릴')}) order by place limit 8"


@query(_ORDERED.replace("@order", "score desc, direct desc, matched desc, exact desc, part desc, detail_only, coalesce(productName, ''), row_no"))
def top3_first_results(spark: SparkSession, d: str) -> DataFrame:
    """The eight answers that are shown first."""
    q = op.read_query("크릴")
    hits = op.ranked(op.score(_index(spark, d), q), q).limit(8)
    best = F.row_number().over(_order([F.desc("score"), F.desc("direct"), F.desc("matched"), F.desc("exact"), F.desc("part"), "detail_only", F.coalesce("productName", F.lit("")), "row_no"]))
    return hits.select("row_no", "productName", "score", best.alias("place"))


def _order(cols: list):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


@query(_ORDERED.replace("@order", "coalesce(productName, ''), row_no"))
def top2_results_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The first eight answers when they are sorted by name."""
    hits = op.score(_index(spark, d), op.read_query("크릴")).orderBy(F.coalesce("productName", F.lit("")), "row_no").limit(8)
    return hits.select("row_no", "productName", "score", F.row_number().over(_order([F.coalesce("productName", F.lit("")), "row_no"])).alias("place"))


_POOL = f"""pool as (select distinct row_no, w, v from (select row_no, unnest([0, 2, 2, 2]) as w, unnest([trim(productName), trim(useCategory), trim(siteLabel), trim(supplier)]) as v from msds_sample
  union all select row_no, unnest([1, 3]), unnest([trim(chemicalName), trim(casNo)]) from msds_ingredient) where v <> '' and length(v) <= 60),
g as (select {_SEARCH('v')} as norm, first(v order by row_no, w, v) as shown, count(*) as n, min(w) as weight from pool group by 1)"""


@query(f"with {_POOL} select norm, shown, {_INITIALS.format(c='norm')} as initials, n, weight from g where norm <> ''")
def agg10_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return op.suggestion_pool(table(spark, d, "msds_sample"), table(spark, d, "msds_ingredient"))


@query(f"""with {_POOL}, i as (select *, {_INITIALS.format(c='norm')} as initials from g where norm <> '') select * from (
  (select '크릴' as typed, shown, n, weight, instr(norm, '크릴') = 1 as begins from i where contains(norm, '크릴') and norm <> '크릴' order by not begins, weight, n desc, length(shown), shown limit 8)
  union all (select 'ㅋㄹ', shown, n, weight, instr(initials, 'ㅋㄹ') = 1 as begins from i where contains(initials, 'ㅋㄹ') and norm <> 'ㅋㄹ' order by not begins, weight, n desc, length(shown), shown limit 8)
  union all (select '1330', shown, n, weight, instr(norm, '1330') = 1 as begins from i where contains(norm, '1330') and norm <> '1330' order by not begins, weight, n desc, length(shown), shown limit 8))""")
def top4_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The eight best completions of a word, of initials and of a number."""
    pool = op.suggestion_pool(table(spark, d, "msds_sample"), table(spark, d, "msds_ingredient"))
    parts = [op.suggestions(pool, t).select(F.lit(t).alias("typed"), "shown", "n", "weight", (F.col("at") == 1).alias("begins")) for t in ("크릴", "ㅋㄹ", "1330")]
    return reduce(DataFrame.unionByName, parts)


@query("""select * from (values ('크릴 thinner', '크릴thinner', '크릴,thinner', false, false, '', '', 'thinner', ''), ('ㅋㄹ', 'ㅋㄹ', 'ㅋㄹ', true, false, '', '', '', ''), ('h 315', 'h315', 'h,315', false, false, 'H315', '', '', ''),
  ('1330-20-7', '1330207', '1330207', false, true, '', '1330-20-7', '', ''), ('신나', '신나', '신나', false, false, '', '', '신나', ''), ('프라이매', '프라이매', '프라이매', false, false, '', '', '', '프라이머 프라이마'),
  ('  ', '', '', false, false, '', '', '', '')) t(raw, whole, tokens, by_initials, is_number, hazard, cas, with_synonyms, near)""")
def rul18_queries(spark: SparkSession, d: str) -> DataFrame:
    """How queries are read: tokens, kind, tokens with synonyms, near words."""
    asked = ["크릴 thinner", "ㅋㄹ", "h 315", "1330-20-7", "신나", "프라이매", "  "]
    rows = [(a, q.whole, ",".join(q.tokens), q.initials, q.numeric, q.hazard, q.cas, " ".join(q.synonyms), " ".join(w for x in q.near.values() for w in x)) for a in asked for q in [op.read_query(a)]]
    return spark.createDataFrame(rows, "raw string, whole string, tokens string, by_initials boolean, is_number boolean, hazard string, cas string, with_synonyms string, near string")


@query(f"select row_no, {_SEARCH('productName')} = '크릴' as is_equal from msds_sample where contains({_SEARCH('productName')}, '크릴') or contains({_SEARCH('erpName')}, '크릴')")
def flt1_contains(spark: SparkSession, d: str) -> DataFrame:
    n, e = keys.search_key(F.col("productName")), keys.search_key(F.col("erpName"))
    return table(spark, d, "msds_sample").where(F.contains(n, F.lit("크릴")) | F.contains(e, F.lit("크릴"))).select("row_no", (n == "크릴").alias("is_equal"))


@query("""select row_no, item_no, regexp_replace(casNo, '\\s', '', 'g') = '1330-20-7' as is_equal from msds_ingredient where contains(regexp_replace(casNo, '[^0-9]', '', 'g'), '133020')""")
def flt2_registry_number(spark: SparkSession, d: str) -> DataFrame:
    """Lines that answer a registry number: equal, or holding its digits (five or more)."""
    digits = F.regexp_replace("casNo", "[^0-9]", "")
    return table(spark, d, "msds_ingredient").where(F.contains(digits, F.lit("133020"))).select("row_no", "item_no", (F.regexp_replace("casNo", r"\s", "") == "1330-20-7").alias("is_equal"))


@query(f"select row_no from msds_sample where contains({_INITIALS.format(c=_SEARCH('productName'))}, 'ㅋㄹ')")
def flt3_initials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").where(F.contains(text.initials(keys.search_key(F.col("productName"))), F.lit("ㅋㄹ"))).select("row_no")


_WORDS = "', '".join(w for g in op.SYNONYMS for w in g if any("가" <= c <= "힣" for c in w))


@query(f"""select w as word, t as term, case when w = t then 0 else 1 end as edits from (select distinct lower(regexp_extract(productName, '[가-힣]{{2,}}')) as w from msds_sample where productName is not null) join (select unnest(['{_WORDS}']) as t)
  on w = t or len(list_filter(range(0, 40), lambda i: left(w, cast(i as int)) = left(t, cast(i as int)) and i <= least(length(w), length(t)) and (
    (length(w) = length(t) and substr(w, cast(i + 2 as int)) = substr(t, cast(i + 2 as int))) or (length(w) = length(t) + 1 and substr(w, cast(i + 2 as int)) = substr(t, cast(i + 1 as int)))
    or (length(t) = length(w) + 1 and substr(t, cast(i + 2 as int)) = substr(w, cast(i + 1 as int)))))) > 0 where w <> ''""")
def scl5_near_words(spark: SparkSession, d: str) -> DataFrame:
    """First Korean words of names that are at most one edit from a known term."""
    w = table(spark, d, "msds_sample").select(F.lower(F.regexp_extract("productName", "[가-힣]{2,}", 0)).alias("word")).where("word <> ''").distinct()
    t = w.select("word", F.explode(F.array(*[F.lit(x) for g in op.SYNONYMS for x in g if any("가" <= c <= "힣" for c in x)])).alias("term"))
    return t.where(F.abs(F.length("word") - F.length("term")) <= 1).withColumn("edits", F.levenshtein("word", "term")).where("edits <= 1")


@query(f"""select row_no, list_transform(list_filter(regexp_extract_all(concat_ws(' ', productName, erpName, fileName, pdfPath), '{_CODE}'), lambda x: length({_SEARCH('x')}) >= 2), lambda x: x) as codes from msds_sample""")
def scl12_code_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", op.code_candidates(F.concat_ws(" ", "productName", "erpName", "fileName", "pdfPath")).alias("codes"))


@query("select row_no, instr(lower(productName), '크릴') as at, substr(productName, 1, instr(lower(productName), '크릴') - 1) as before, substr(productName, instr(lower(productName), '크릴') + 2) as after from msds_sample where contains(lower(productName), '크릴')")
def scl43_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Where a typed word stands in a shown name: the parts before and after it."""
    at = F.instr(F.lower("productName"), F.lit("크릴"))
    s = table(spark, d, "msds_sample").withColumn("at", at).where("at > 0")
    return s.select("row_no", "at", F.expr("substring(productName, 1, at - 1)").alias("before"), F.expr("substring(productName, at + 2)").alias("after"))


@query(f"""select row_no, c as code, count(*) as n from (select row_no, unnest(list_transform(regexp_extract_all({_LIST('hazardStatements')} || ' ' || {_ALL_P}, '(?i)\\b[HP]\\s*[-_]?\\s*[0-9]{{3}}\\b'), lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g'))) as c from msds_sample) group by row_no, c""")
def scl11_hazard_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes in all statements of an entry, also with a blank or dash inside."""
    p = [F.array_join(F.col(f"precautionaryStatements.{x}"), " ") for x in _P]
    found = F.regexp_extract_all(F.concat_ws(" ", F.array_join("hazardStatements", " "), *p), F.lit(r"(?i)(?<![0-9A-Za-z_])[HP]\s*[-_]?\s*[0-9]{3}(?![0-9A-Za-z_])"), F.lit(0))
    s = table(spark, d, "msds_sample").select("row_no", F.explode(F.transform(found, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))).alias("code"))
    return s.groupBy("row_no", "code").agg(F.count(F.lit(1)).alias("n"))
