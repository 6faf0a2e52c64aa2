"""Queries of the rules on safety texts over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.functions import keys, rules, text
from vialworks.plans.catalogue import _B, _SEARCH, query
from vialworks.sources.tables import table

LISTS = ("prevention", "response", "storage", "disposal")
_SQUEEZE = lambda c: f"regexp_replace(lower({c}), '[{_B}]', '', 'g')"
_HAS = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_PRE = "(select row_no, list, pos, trim(s) as s from (" + " union all ".join(f"select row_no, '{p}' as list, {i} as o, generate_subscripts(precautionaryStatements.{p}, 1) as pos, unnest(precautionaryStatements.{p}) as s from msds_sample" for i, p in enumerate(LISTS)) + ") where s is not null and trim(s) <> '')"


def precautions(s: DataFrame) -> DataFrame:
    """(row_no, list, pos, s): every precaution that isn't blank."""
    parts = F.array(*[F.struct(F.lit(p).alias("list"), F.col(f"precautionaryStatements.{p}").alias("xs")) for p in LISTS])
    long = s.select("row_no", F.explode(parts).alias("p")).select("row_no", "p.list", F.posexplode("p.xs").alias("pos", "s"))
    return long.select("row_no", "list", (F.col("pos") + 1).alias("pos"), F.trim("s").alias("s")).where("s <> ''")


_SENT = lambda c: f"list_filter(list_transform(string_split_regex(regexp_replace({c}, '\\s([가-하]\\.)', chr(10) || '\\1', 'g'), '[.。!?;]\\s*|\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_KEPT = f"array_to_string(list_filter({_SENT('ppeSummary')}, lambda x: not {_HAS(_SQUEEZE('x'), rules.FIRE)}), ' ')"
_KINDS = ", ".join(f"case when {_HAS('j', ws)} then '{k}' end" for k, ws in rules.MASKS.items())


@query(f"""select row_no, {", ".join(f"coalesce({_HAS('j', ws)}, false) as {k}" for k, ws in rules.EQUIPMENT.items())},
  case when {_HAS('j', rules.EQUIPMENT['mask'])} then case when len(kinds) = 1 then kinds[1] else '호흡보호구' end end as mask_kind
  from (select row_no, j, list_filter([{_KINDS}], lambda x: x is not null) as kinds from (select row_no, {_SQUEEZE(_KEPT)} as j from msds_sample))""")
def rul9_equipment(spark: SparkSession, d: str) -> DataFrame:
    """Equipment named in the summary, sentence by sentence, without sentences on fire fighting."""
    s = table(spark, d, "msds_sample")
    flags, mask = rules.equipment(F.array("ppeSummary"))
    return s.select("row_no", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()], mask.alias("mask_kind"))


_MARK = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '(?i)^\\s*section\\s*[0-9]+\\s*[–—:-]?\\s*', ''), '^\\s*(?:[-–—•·*○●◦□■]\\s*)+', ''), '^\\s*(?:[0-9]+(?:\\.[0-9]+)*\\.?|[0-9]+\\)|[가-하]\\.|[a-zA-Z]\\.)\\s*', ''))"


@query(f"""with v as (select override_no, p.pos as pos, p.c as c from (select override_no, unnest(list_transform(range(1, len(ppeCandidates) + 1), lambda i: {{'pos': i, 'c': ppeCandidates[i]}})) as p from msds_overrides)),
  a as (select *, {_MARK("trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'))")} as t from v), b as (select *, regexp_replace(t, '(?i)^(?:{rules.heading_pattern()})', '') as bare from a),
  e as (select override_no, pos, {_MARK("case when bare <> t then trim(regexp_replace(bare, '^\\s*[:：\\-–]\\s*', '')) else t end")} as u from b)
  select override_no, pos, case when length(r) < 4 or starts_with(r, '자료없음') then '' else u end as cleaned from (select *, regexp_replace({_SQUEEZE('u')}, '[^0-9a-z가-힣]', '', 'g') as r from e)""")
def rul10_equipment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Equipment lines of the documents without their headings."""
    o = table(spark, d, "msds_overrides").select("override_no", F.posexplode("ppeCandidates").alias("p", "c"))
    return o.select("override_no", (F.col("p") + 1).cast("bigint").alias("pos"), rules.equipment_candidate(F.col("c")).alias("cleaned"))


_K = _SEARCH("concat_ws(' ', productName, erpName, useCategory, ppeSummary, array_to_string(hazardStatements, ' '))")


@query(f"select row_no, array_to_string(list_filter([{', '.join(f'''case when {_HAS('k', [w for w in ws])} then '{g}{n}' end''' for g, n, ws in rules.CAUTIONS)}], lambda x: x is not null), ',') as warnings from (select row_no, {_K} as k from msds_sample)")
def rul11_worker_cautions(spark: SparkSession, d: str) -> DataFrame:
    """The warnings that an entry's texts ask for, as group and number."""
    t = F.concat_ws(" ", "productName", "erpName", "useCategory", "ppeSummary", F.array_join("hazardStatements", " "))
    s = table(spark, d, "msds_sample").select("row_no", keys.search_key(t).alias("k"))
    return s.select("row_no", F.array_join(rules.cautions(F.col("k")), ",").alias("warnings"))


_VOMIT = rules.VOMIT.replace("\\", "\\")


@query(f"""with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.다오함])\\s+', '\\1' || chr(10), 'g'), '\\n')) as s, text from documents where text is not null)
  select doc_id, count(*) as advised, count(*) filter (regexp_matches(text, 'H304|H314|P331')) as contradicting from s where regexp_matches(s, '{rules.VOMIT}') and not regexp_matches(s, '{rules.NO_VOMIT}') group by doc_id""")
def rul12_vomit(spark: SparkSession, d: str) -> DataFrame:
    """Documents that advise to induce vomiting, and the sentences that contradict a code of the same document."""
    t = F.col("text")
    parts = F.split(F.regexp_replace(t, r"([.다오함])\s+", "$1\n"), "\n")
    bad = F.filter(parts, lambda x: x.rlike(rules.VOMIT) & ~x.rlike(rules.NO_VOMIT))
    n = F.size(bad).cast("bigint")
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("advised"), F.when(t.rlike("H304|H314|P331"), n).otherwise(F.lit(0).cast("bigint")).alias("contradicting")).where("advised > 0")


_CODE_SQL = lambda g: "len(list_intersect(codes, ['" + "', '".join(rules.PRECAUTION_CODES[g]) + "'])) > 0"


@query(f"""select row_no, list, pos, case when len(codes) = 0 then '' {' '.join(f"when {_CODE_SQL(g)} then '{g}'" for g in rules.PRECAUTION_CODES)} {' '.join(f"when {_HAS('k', ws)} then '{g}'" for g, ws in rules.PRECAUTION_WORDS.items())}
  when list_contains(digits, '4') then 'storage' when list_contains(digits, '5') then 'disposal' when list_contains(digits, '3') then 'response' when list_contains(digits, '2') then 'prevention' else '' end as grp
  from (select *, list_transform(codes, lambda x: substr(x, 2, 1)) as digits from (select row_no, list, pos, regexp_extract_all(upper(s), 'P[0-9]{{3}}') as codes, {_SEARCH('s')} as k from {_PRE}))""")
def rul7_precaution_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every precaution: by its codes, then by its words."""
    p = precautions(table(spark, d, "msds_sample")).select("row_no", "list", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract_all(F.upper("s"), F.lit("P[0-9]{3}"), F.lit(0)).alias("codes"), keys.search_key(F.col("s")).alias("k"))
    return p.select("row_no", "list", "pos", rules.precaution_group(F.col("codes"), F.col("k")).alias("grp"))


_PART = "list_filter(list_transform(string_split_regex(coalesce(t, ''), '[\\n;；/]|,\\s'), lambda x: regexp_replace(" + _SQUEEZE("x") + ", '[()\\[\\]·ㆍ:：\\-_,./]', '', 'g')), lambda x: x <> '')"
_WANT = lambda rs: "(" + " or ".join(f"len(list_filter(parts, lambda x: {_HAS('x', ns)} and {_HAS('x', cs)})) > 0" if ns else _HAS("array_to_string(parts, ' ')", cs) for ns, cs in rs) + ")"


@query(f"""select doc_id, case when {_HAS('k', rules.NO_LABEL)} then '' else array_to_string(list_filter([{", ".join(f"case when {_WANT(r)} then '{g}' end" for g, r in rules.CLASSES.items())}], lambda x: x is not null), ',') end as codes
  from (select doc_id, {_SEARCH('t')} as k, {_PART} as parts from (select doc_id, text as t from documents where text is not null))""")
def rul1_inferred_pictograms(spark: SparkSession, d: str) -> DataFrame:
    """Pictograms inferred from class, category and codes in a document's text."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", keys.search_key(F.col("text")).alias("key"), rules.classification_parts(F.col("text")).alias("parts"))
    t = t.select("*", rules.categories(F.col("parts")).alias("named"), rules.hazard_codes(F.col("parts")).alias("found"))
    return t.select("doc_id", F.array_join(rules.inferred_pictograms(F.col("key"), F.col("parts"), F.col("named"), F.col("found")), ",").alias("codes"))


@query(f"""select row_no, list_contains(ws, coalesce(k, '')) as no_label from (select row_no, {_HAS(_SEARCH('signalWord'), rules.NO_LABEL)} as k2, {_SEARCH('signalWord')} as k, ['해당없음'] as ws from msds_sample) where false
  union all select row_no, coalesce({_HAS(_SEARCH('signalWord'), rules.NO_LABEL)}, false) from msds_sample""")
def flt18_no_label(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose signal word says that there's no label element."""
    return table(spark, d, "msds_sample").select("row_no", rules.no_label_element(F.col("signalWord")).alias("no_label"))


def _codes(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.array_join(s, " "), F.lit("H[0-9]{3}"), F.lit(0)))


_NEEDS = "', '".join(h for hs in text.REQUIRED.values() for h in hs.split())
_ELEMENTS = f"""select row_no, coalesce(hazardNotClassified, false) as none, coalesce(trim(signalWord) in ('위험', '경고'), false) as word, coalesce(len(ghsPictograms), 0) + coalesce(len(ghsCodes), 0) > 0 as signs,
  coalesce(len(list_filter(hazardStatements, lambda x: trim(x) <> '')), 0) > 0 as hazards, {" + ".join(f"coalesce(len(list_filter(precautionaryStatements.{p}, lambda x: trim(x) <> '')), 0)" for p in LISTS)} > 0 as cautions,
  coalesce(len(list_intersect(regexp_extract_all(coalesce(array_to_string(hazardStatements, ' '), ''), 'H[0-9]{{3}}'), ['{_NEEDS}'])), 0) > 0 as needs from msds_sample"""


def label_elements(s: DataFrame) -> DataFrame:
    """(row_no, none, word, signs, hazards, cautions, needs): which elements of a label an entry has, and whether its
    hazard codes ask for a pictogram."""
    some = lambda c: F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")) > 0, F.lit(False))
    any_of = F.lit(False)
    for p in LISTS:
        any_of = any_of | some(F.col(f"precautionaryStatements.{p}"))
    needs = F.arrays_overlap(_codes(F.col("hazardStatements")), F.array(*[F.lit(h) for hs in text.REQUIRED.values() for h in hs.split()]))
    signs = (F.coalesce(F.size("ghsPictograms"), F.lit(0)) > 0) | (F.coalesce(F.size("ghsCodes"), F.lit(0)) > 0)
    return s.select(
        "row_no", F.coalesce("hazardNotClassified", F.lit(False)).alias("none"), F.coalesce(F.trim("signalWord").isin("위험", "경고"), F.lit(False)).alias("word"), signs.alias("signs"),
        some(F.col("hazardStatements")).alias("hazards"), any_of.alias("cautions"), F.coalesce(needs, F.lit(False)).alias("needs"),
    )


@query(f"select row_no, none or ((word or signs or hazards or cautions) and not (needs and not signs)) as printable, needs and not signs as lacks_sign from ({_ELEMENTS})")
def flt8_printable(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose label can be printed: not classified, or with elements and with a pictogram where codes ask for one."""
    e = label_elements(table(spark, d, "msds_sample"))
    lacks = F.col("needs") & ~F.col("signs")
    return e.select("row_no", (F.col("none") | ((F.col("word") | F.col("signs") | F.col("hazards") | F.col("cautions")) & ~lacks)).alias("printable"), lacks.alias("lacks_sign"))


@query(f"select row_no, signs or hazards or cautions as postable from ({_ELEMENTS})")
def flt9_postable(spark: SparkSession, d: str) -> DataFrame:
    return label_elements(table(spark, d, "msds_sample")).select("row_no", (F.col("signs") | F.col("hazards") | F.col("cautions")).alias("postable"))


@query(f"""select s.row_no, contains(k, '크릴') and (printable or picked) as shown from (select row_no, {_SEARCH("concat_ws(' ', productName, supplier, useCategory, msdsNo)")} as k, load_no = 1 as picked from msds_sample) s
  join (select row_no, none or ((word or signs or hazards or cautions) and not (needs and not signs)) as printable from ({_ELEMENTS})) p using (row_no)""")
def flt7_label_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entries shown for a word where only printable ones are asked for; picked ones (here the first load) stay."""
    s = table(spark, d, "msds_sample")
    k = keys.search_key(F.concat_ws(" ", "productName", "supplier", "useCategory", "msdsNo"))
    return s.select("row_no", F.contains(k, F.lit("크릴")).alias("hit"), (F.col("load_no") == 1).alias("picked")).join(flt8_printable(spark, d), "row_no").select("row_no", (F.col("hit") & (F.col("printable") | F.col("picked"))).alias("shown"))


_SEV = "list_position(['" + "', '".join(rules.SEVERITY) + "'], c)"


@query(f"""select row_no, place, s as statement from (select row_no, s, row_number() over (partition by row_no order by coalesce({_SEV}, {len(rules.SEVERITY) + 1}), pos) as place from (
  select row_no, pos, s, regexp_extract(s, '(?:^|[^0-9A-Za-z_])(H[0-9]{{3}})(?:$|[^0-9A-Za-z_])', 1) as c from (select row_no, generate_subscripts(hazardStatements, 1) as pos, trim(unnest(hazardStatements)) as s from msds_sample) where s <> '')) where place <= 5""")
def top5_gravest_hazards(spark: SparkSession, d: str) -> DataFrame:
    """The five gravest hazard statements of every entry, gravest first; the order is found within the list."""
    ranked = F.transform("hazardStatements", lambda x, i: F.struct(rules.severity(F.trim(x)).alias("rank"), i.alias("i"), F.trim(x).alias("s")))
    first = F.slice(F.array_sort(F.filter(ranked, lambda x: x.s != "")), 1, 5)
    out = table(spark, d, "msds_sample").select("row_no", F.posexplode(first).alias("p", "x"))
    return out.select("row_no", (F.col("p") + 1).cast("bigint").alias("place"), F.col("x.s").alias("statement"))


_CLEAN = lambda c: f"trim(regexp_replace({c}, '^[-\\s]+', ''))"
_ORDER = "case list when 'prevention' then 0 when 'response' then 1 when 'storage' then 2 else 3 end"


@query(f"""with p as (select row_no, list, pos, {_CLEAN('s')} as s, {_ORDER} as o from {_PRE}), q as (select *, row_number() over (partition by row_no, list order by pos) as nth from p where s <> ''),
  r as (select row_no, s, min(case when nth = 1 then o else 10 + o * 100000 + pos end) as spot from q group by row_no, s) select row_no, place, s as statement from (select row_no, s, row_number() over (partition by row_no order by spot) as place from r) where place <= 6""")
def top6_precaution_quota(spark: SparkSession, d: str) -> DataFrame:
    """At most six precautions of an entry: the first of every group, then the rest in order, none twice."""
    clean = lambda p: F.filter(F.transform(F.coalesce(F.col(f"precautionaryStatements.{p}"), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"^[-\s]+", ""))), lambda x: x.isNotNull() & (x != ""))
    lists = [clean(p) for p in LISTS]
    picked = F.slice(F.array_distinct(F.concat(*[F.slice(x, 1, 1) for x in lists], *lists)), 1, 6)
    out = table(spark, d, "msds_sample").select("row_no", F.posexplode(picked).alias("p", "statement"))
    return out.select("row_no", (F.col("p") + 1).cast("bigint").alias("place"), "statement")


@query("""select row_no, c as code from (select row_no, pos, c, count(*) over (partition by row_no) as n, row_number() over (partition by row_no order by pos) as r from (select row_no, c, min(pos) as pos from (
  select row_no, generate_subscripts(codes, 1) as pos, upper(unnest(codes)) as c from (select row_no, case when len(ghsPictograms) > 0 then list_transform(ghsPictograms, lambda x: x.code) else ghsCodes end as codes from msds_sample))
  where regexp_full_match(c, 'GHS0[1-9]') group by row_no, c)) where n < 5 or r <= 4""")
def top8_pictogram_cap(spark: SparkSession, d: str) -> DataFrame:
    """The pictograms of a label: all of up to four, the first four of five and more."""
    own = F.when(F.size("ghsPictograms") > 0, F.col("ghsPictograms.code")).otherwise(F.col("ghsCodes"))
    codes = F.array_distinct(F.filter(F.transform(own, F.upper), lambda x: x.rlike("^GHS0[1-9]$")))
    return table(spark, d, "msds_sample").select("row_no", F.explode(F.when(F.size(codes) >= 5, F.slice(codes, 1, 4)).otherwise(codes)).alias("code"))


_SPILL, _FIRE = ["누출", "유출", "엎질러", "흘린"], ["화재", "소화", "연소"]
_FIRST = lambda ws: f"list_filter(precautionaryStatements.response, lambda x: {_HAS('x', ws)})[1]"


@query(f"select row_no, {_FIRST(_SPILL)} as spill, case when {_FIRST(_FIRE)} is distinct from {_FIRST(_SPILL)} then {_FIRST(_FIRE)} end as fire from msds_sample")
def rul13_emergency_items(spark: SparkSession, d: str) -> DataFrame:
    """The first response on spills and the first on fire, none twice."""
    pick = lambda ws: F.get(F.filter("precautionaryStatements.response", lambda x: rules.holds(x, ws)), F.lit(0))
    spill, fire = pick(_SPILL), pick(_FIRE)
    return table(spark, d, "msds_sample").select("row_no", spill.alias("spill"), F.when(~fire.eqNullSafe(spill), fire).alias("fire"))


_HANDLING = ["보관", "저장", "환기", "밀폐", "정전기", "접지", "화기", "점화", "열", "고온", "직사광선", "습기", "용기", "혼합", "온도"]
_DK = lambda c: f"regexp_replace({c}, '[{_B}.,·/]', '', 'g')"


@query(f"""with p as (select row_no, s, pos + case list when 'storage' then 0 else 1000000 end as spot, {_DK('s')} as k from {_PRE} where list = 'storage' or (list = 'prevention' and {_HAS('s', _HANDLING)})),
  u as (select row_no, arg_min(s, spot) as s, min(spot) as spot from p group by row_no, k) select row_no, place, s as statement from (select row_no, s, row_number() over (partition by row_no order by spot) as place from u) where place <= 4""")
def rul14_handling_items(spark: SparkSession, d: str) -> DataFrame:
    """At most four items on storage and handling: storage first, then precautions with such words, none twice."""
    clean = lambda p: F.filter(F.transform(F.coalesce(F.col(f"precautionaryStatements.{p}"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    pool = F.concat(clean("storage"), F.filter(clean("prevention"), lambda x: rules.holds(x, _HANDLING)))
    keyed = F.transform(pool, lambda x: F.struct(keys.item_key(x).alias("k"), x.alias("s")))
    first = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y.k), x.k) == i + 1)
    out = table(spark, d, "msds_sample").select("row_no", F.posexplode(F.slice(first, 1, 4)).alias("p", "x"))
    return out.select("row_no", (F.col("p") + 1).cast("bigint").alias("place"), F.col("x.s").alias("statement"))


_SIGNAL = lambda c: f"case when {_SEARCH(c)} in ('위험', 'danger') then '위험' when {_SEARCH(c)} in ('경고', 'warning') then '경고' when {_SEARCH(c)} in ('해당없음', '신호어없음', 'notapplicable', 'none') then '해당없음' else '' end"


@query(f"""select override_no, len(ghsCodes) > 0 and ({_SIGNAL("coalesce(signalWordCandidate, '')")} = '해당없음') as conflict from msds_overrides""")
def rul17_pictogram_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Documents with pictograms whose signal word says there's none."""
    return table(spark, d, "msds_overrides").select("override_no", ((F.size("ghsCodes") > 0) & (text.signal_word(F.coalesce("signalWordCandidate", F.lit(""))) == "해당없음")).alias("conflict"))


@query(f"""select row_no, case when coalesce(hazardNotClassified, false) then '해당없음' else {_SIGNAL("coalesce(signalWord, '')")} end as signal from msds_sample""")
def scl31_signal_words(spark: SparkSession, d: str) -> DataFrame:
    """The signal word of an entry; none stated where it isn't classified."""
    s = F.when(F.coalesce("hazardNotClassified", F.lit(False)), "해당없음").otherwise(text.signal_word(F.coalesce("signalWord", F.lit(""))))
    return table(spark, d, "msds_sample").select("row_no", s.alias("signal"))


@query("""with o as (select productId, first(ghsCodes order by override_no) as codes, first(ghsSource order by override_no) as src from msds_overrides where productId is not null group by productId)
  select row_no, array_to_string(case when len(p) > 0 and src is distinct from 'section2_classification_fallback' and len(codes) > 0 and len(p) = 0 then codes when len(p) > 0 then p
    when len(codes) > 0 and src is distinct from 'section2_classification_fallback' then codes else g end, ',') as codes
  from (select row_no, id, coalesce(list_transform(ghsPictograms, lambda x: x.code), []) as p, coalesce(ghsCodes, []) as g from msds_sample) s left join o on o.productId = s.id""")
def rul5_pictogram_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The pictograms that are shown: the entry's label, the document's unless it was only inferred, the entry's own."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy("productId").agg(F.min(F.struct("override_no", "ghsCodes", "ghsSource")).alias("o"))
    j = table(spark, d, "msds_sample").join(o, F.col("id") == F.col("productId"), "left")
    none = F.lit(None).cast("array<string>")
    return j.select("row_no", F.array_join(rules.explicit_pictograms(none, F.col("ghsPictograms.code"), F.col("o.ghsCodes"), F.col("o.ghsSource") == "section2_classification_fallback", none, F.col("ghsCodes")), ",").alias("codes"))


@query("""select row_no, least(greatest(coalesce(try_cast(regexp_extract(revisionDate, '([0-9]{1,3})$', 1) as int), 1), 1), 60) as copies from msds_sample""")
def flt21_copies(spark: SparkSession, d: str) -> DataFrame:
    """A number of copies read from a text, between 1 and 60; 1 where there's none."""
    n = F.regexp_extract("revisionDate", "([0-9]{1,3})$", 1).try_cast("int")
    return table(spark, d, "msds_sample").select("row_no", F.least(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), F.lit(60)).alias("copies"))


_ACTIONS = ["하시오", "마시오", "피하", "착용", "보관", "폐기", "조치", "씻으시오", "받으시오"]


@query(f"select row_no, list, count(*) as lines, count(*) filter (not (regexp_matches(s, '(^|[^0-9A-Za-z_가-힣])P[0-9]{{3}}($|[^0-9A-Za-z_가-힣])') or {_HAS('s', _ACTIONS)})) as no_precaution from {_PRE} group by row_no, list")
def flt20_precaution_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are precautions by a code or a word for an action, and those that aren't."""
    is_one = F.col("s").rlike(r"(^|[^0-9A-Za-z_가-힣])P[0-9]{3}($|[^0-9A-Za-z_가-힣])") | rules.holds(F.col("s"), _ACTIONS)
    return precautions(table(spark, d, "msds_sample")).groupBy("row_no", "list").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~is_one).alias("no_precaution"))


@query(f"""with o as (select productId, first(supplierCandidate order by override_no) as v from msds_overrides where productId is not null group by 1)
  select row_no, case when b = '' then 'keep' when a = '' then 'fill' when a = b then 'keep' when contains(b, a) then 'extend' else 'conflict' end as decision
  from (select row_no, {_SEARCH("coalesce(supplier, '')")} as a, {_SEARCH("coalesce(v, '')")} as b from msds_sample join o on o.productId = id)""")
def flt19_update_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's value fills, extends, keeps or contradicts the entry's."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy("productId").agg(F.min_by("supplierCandidate", "override_no").alias("v"))
    return table(spark, d, "msds_sample").join(o, F.col("id") == F.col("productId")).select("row_no", rules.update_decision(F.col("supplier"), F.col("v")).alias("decision"))


#: Words of file names that are no safety sheets.
_SUSPECT = ["qr", "qr코드", "코드", "안내", "표지", "카탈로그", "catalog", "brochure", "시험성적", "성적서", "인증서", "사진", "이미지"]


@query(f"select inventory_no, {_HAS('k', _SUSPECT)} as suspicious, case when {_HAS('k', _SUSPECT)} then 'check' when n > 1 then 'check' else 'register' end as action from (select *, lower(concat_ws(' ', relativePath, fileName)) as k, count(*) over (partition by sha256) as n from pdf_inventory)")
def rul16_suggested_action(spark: SparkSession, d: str) -> DataFrame:
    """What to do with a file: check it where its name is suspicious or its content occurs twice, else register it."""
    p = table(spark, d, "pdf_inventory")
    copies = p.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("sha256", "h")
    bad = rules.holds(F.lower(F.concat_ws(" ", "relativePath", "fileName")), _SUSPECT)
    return p.join(copies, F.col("sha256").eqNullSafe(F.col("h"))).select("inventory_no", bad.alias("suspicious"), F.when(bad | (F.col("n") > 1), "check").otherwise("register").alias("action"))


@query(f"select inventory_no, array_to_string(list_filter([{', '.join(f'''case when contains(k, '{w}') then '{w}' end''' for w in _SUSPECT)}], lambda x: x is not null)[1:5], ',') as words from (select inventory_no, lower(concat_ws(' ', relativePath, fileName)) as k from pdf_inventory)")
def flt12_suspicion(spark: SparkSession, d: str) -> DataFrame:
    """The words by which a file seems to be no safety sheet, at most five."""
    k = F.lower(F.concat_ws(" ", "relativePath", "fileName"))
    return table(spark, d, "pdf_inventory").select("inventory_no", F.array_join(F.slice(F.array_compact(F.array(*[F.when(F.contains(k, F.lit(w)), F.lit(w)) for w in _SUSPECT])), 1, 5), ",").alias("words"))
