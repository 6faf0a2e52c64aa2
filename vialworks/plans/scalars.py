"""Queries of scalar functions and projections over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.functions import cleaning as cl
from vialworks.functions import keys
from vialworks.plans.catalogue import _BASE, _SEARCH, query
from vialworks.sources.tables import table

LISTS = ("prevention", "response", "storage", "disposal")
_SP = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{3000}}\\x{{a0}}]+', ' ', 'g'))"
_WORD = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_N = "regexp_extract_all({c}, '[0-9]+')"
_FMT = lambda a, b, c: f"{a} || '-' || lpad({b}, 2, '0') || '-' || lpad({c}, 2, '0')"
_YMD, _DMY, _KO = cl.YMD, cl.DMY, cl.KOREAN


def _written(c: str) -> str:
    n = _N.format(c=c)
    return f"""case when regexp_matches({c}, '^{_YMD}') then {_FMT(f'{n}[1]', f'ltrim({n}[2], chr(48))', f'ltrim({n}[3], chr(48))')} when regexp_matches({c}, '^{_DMY}') then {_FMT(f'{n}[3]', f'ltrim({n}[2], chr(48))', f'ltrim({n}[1], chr(48))')}
  when regexp_matches({c}, '^{_KO}') then {_FMT(f"regexp_extract({c}, '([0-9]{{4}})$', 1)", f"ltrim(regexp_extract({c}, '([0-9]{{1,2}})\\s*월', 1), chr(48))", f"ltrim({n}[1], chr(48))")} end"""


_DATED = """select {key}, case when regexp_matches(s, '{no}') then '' else coalesce(case when try_cast(d as date) is not null then d end, '') end as day from (select {key}, s, {written} as d from (
  select {key}, s, m[len(m)] as l from (select {key}, s, regexp_extract_all(regexp_replace(regexp_replace(s, '^(?:최종\\s*)?개정\\s*일자?\\s*[:：]?\\s*', ''), '^자\\s*[:：]?\\s*', ''), '{ymd}|{dmy}|{ko}') as m from (select {key}, {v} as s from {t}))))"""


@query(_DATED.format(key="row_no", no=cl.NO_DATE, written=_written("l"), ymd=_YMD, dmy=_DMY, ko=_KO, v=_SP("revisionDate"), t="msds_sample"))
def scl8_clean_dates(spark: SparkSession, d: str) -> DataFrame:
    """The last sound date of every text."""
    return table(spark, d, "msds_sample").select("row_no", cl.clean_date(F.col("revisionDate")).alias("day"))


@query(f"""select row_no, case when regexp_matches(s, '{cl.NO_DATE}') then '' when regexp_matches(v, '{_YMD}') then {_written(f"regexp_extract(v, '({_YMD})', 1)")} when regexp_matches(v, '{_DMY}') then {_written(f"regexp_extract(v, '({_DMY})', 1)")} else '' end as day
  from (select row_no, s, regexp_replace(s, '^(?:최종\\s*)?개정\\s*일자?\\s*[:：]?\\s*', '') as v from (select row_no, {_SP('revisionDate')} as s from msds_sample))""")
def scl8_shown_dates(spark: SparkSession, d: str) -> DataFrame:
    """The first date of every text as it is shown, whether the calendar has it or not."""
    return table(spark, d, "msds_sample").select("row_no", cl.shown_date(F.col("revisionDate")).alias("day"))


@query(f"select row_no, regexp_full_match({_SP('revisionDate')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast({_SP('revisionDate')} as date) is not null as is_iso, regexp_matches({_SP('revisionDate')}, '{cl.NO_DATE}') as is_placeholder from msds_sample")
def scl41_date_shapes(spark: SparkSession, d: str) -> DataFrame:
    v = cl.spaces(F.col("revisionDate"))
    iso = v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull()
    return table(spark, d, "msds_sample").select("row_no", F.coalesce(iso, F.lit(False)).alias("is_iso"), v.rlike(cl.NO_DATE).alias("is_placeholder"))


@query("with d as (" + _DATED.format(key="row_no", no=cl.NO_DATE, written=_written("l"), ymd=_YMD, dmy=_DMY, ko=_KO, v=_SP("revisionDate"), t="msds_sample") + ") select row_no, '배포일: ' || strftime(loaded_at, '%Y-%m-%d') || case when day <> '' then ' / 최종 개정일: ' || day else '' end as summary from d join msds_sample using (row_no)")
def scl34_date_summary(spark: SparkSession, d: str) -> DataFrame:
    """The dates of a delivery in one labelled text."""
    day = cl.clean_date(F.col("revisionDate"))
    return table(spark, d, "msds_sample").select("row_no", F.concat_ws(" / ", F.concat(F.lit("배포일: "), F.date_format("loaded_at", "yyyy-MM-dd")), F.when(day != "", F.concat(F.lit("최종 개정일: "), day))).alias("summary"))


_STOPS = f"(?:{cl.REGIONS})", f"(?:{cl.AFTER_COMPANY})"
_CO = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SP('supplier')}, '{cl.COMPANY_LABEL}', ''), '^[0-9]+_\\s*', ''), '\\([^)]*\\)', '', 'g'), '{cl.LEGAL}', '', 'g'))"
_CUT = lambda c, p: f"trim(case when regexp_matches(substr({c}, 2), '(?i){p}') then regexp_extract({c}, '(?is)^(.+?){p}', 1) else {c} end)"


@query(f"""select row_no, case when length(v) > 45 or regexp_matches(v, '(?i)^[0-9]{{2,7}}-[0-9]{{2,3}}-[0-9]{{1,4}}$|CAS\\s*(?:No\\.?)?\\s*(?:미기재|없음)|자료없음|해당없음|업체\\s*미확인|[0-9]{{2,4}}\\)?\\s*[0-9]{{3,4}}[-\\s][0-9]{{4}}|도로|로\\s*[0-9]|길\\s*[0-9]|번길|산단로') then '' else v end as company
  from (select row_no, trim(regexp_replace({_CUT('b', _STOPS[1])}, '[,:：;/]+$', '')) as v from (select row_no, {_CUT('a', _STOPS[0])} as b from (select row_no, {_CO} as a from msds_sample)))""")
def scl18_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies without legal forms, labels, addresses and contacts."""
    return table(spark, d, "msds_sample").select("row_no", cl.company(F.col("supplier")).alias("company"))


@query(f"select row_no, length({_SP('supplier')}) <= 80 and not regexp_matches({_SP('supplier')}, '(?i)^[-.:/]*$|자료\\s*없음|^정보\\s*:?$|유통업자\\s*정보|공급자\\s*/\\s*유통업자\\s*정보|권고\\s*용도|보관하시오|safety\\s+data\\s+sheet|information') as supplier_ok, {_SP('productName')} <> '' and length({_SP('productName')}) <= 90 and not regexp_matches({_SP('productName')}, '권고\\s*용도|사용상의\\s*제한') as name_ok from msds_sample")
def flt15_plausible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", cl.plausible_supplier(F.col("supplier")).alias("supplier_ok"), cl.plausible_product(F.col("productName")).alias("name_ok"))


_FILE = "regexp_replace(regexp_replace(coalesce(fileName, ''), '(?i)\\.pdf$', ''), '_+', ' ', 'g')"
for _p in (r"(?i)\b(?:msds|ghs)\b", r"\b[0-9]{4}[-_.]?[0-9]{2}[-_.]?[0-9]{2}\b", r"\b[0-9]{2}[-_.][0-9]{2}[-_.][0-9]{2}\b", r"(?i)\b(?:ver(?:sion)?|rev(?:ision)?)\s*[0-9]+[a-z]?\b", r"[0-9]+\s*차\s*개정", r"\s+[-–—]+\s+"):
    _FILE = f"regexp_replace({_FILE}, '{_p}', ' ', 'g')"
_FILE = f"regexp_replace({_FILE}, '([^\\s(])({'|'.join(cl.TERMS)})', '\\1 \\2', 'g')"


@query(f"select row_no, {_SP(_FILE)} as name from msds_sample")
def scl19_names_of_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", cl.product_of_file(F.col("fileName")).alias("name"))


def _field_sql(c: str, end: str, most: int) -> str:
    v = _SP(c)
    head = f"case when regexp_matches(substr({v}, 2), '{end}') then regexp_replace(regexp_extract({v}, '^(.+?)(?:{end})', 1), '^[\\s,;·-]+|[\\s,;·-]+$', '', 'g') else {v} end"
    labels = "', '".join(cl.ONLY_LABELS)
    return f"case when {v} in ('{labels}') then '' when length({head}) > {most} then rtrim(left({head}, {most})) || '…' else {head} end"


@query(f"select row_no, {_field_sql('supplier', cl.NEXT_SECTION, 90)} as supplier, {_field_sql('supplierAddress', cl.ADDRESS_END, 90)} as address, {_field_sql('emergencyContact', cl.NEXT_SECTION, 120)} as contact from msds_sample")
def scl20_supplier_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "msds_sample").select("row_no", cl.supplier_field(c("supplier"), cl.NEXT_SECTION, 90).alias("supplier"), cl.supplier_field(c("supplierAddress"), cl.ADDRESS_END, 90).alias("address"), cl.supplier_field(c("emergencyContact"), cl.NEXT_SECTION, 120).alias("contact"))


_LINES = f"list_filter(list_transform(coalesce(hazardStatements, []), lambda x: {_SP('x')}), lambda x: x <> '')"
_CODED = "list_filter(l, lambda x: regexp_matches(x, '(^|[^0-9A-Za-z_가-힣])H[0-9]{3}($|[^0-9A-Za-z_가-힣])'))"


@query(f"select row_no, array_to_string(case when len({_CODED}) > 0 then {_CODED} else l end, '|') as lines from (select row_no, {_LINES} as l from msds_sample)")
def scl21_coded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hazard statements without uncoded lines, where any is coded."""
    return table(spark, d, "msds_sample").select("row_no", F.array_join(cl.coded_only(F.col("hazardStatements")), "|").alias("lines"))


_SHOWN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({_SP(c)}, '([.!?。])([^\\s.!?。])', '\\1 \\2', 'g'), '([가-힣)])([PH][0-9]{{3}})', '\\1 \\2', 'g'), '\\)\\s*\\(', ') (', 'g'))"


@query(f"select row_no, pos, {_SHOWN('s')} as shown from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample) where s is not null and not regexp_matches(s, '[.!?。][.!?。]')")
def scl15_shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """Statements with single blanks, and one after a stop and before a code; those without repeated stops."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s")).where(F.col("s").isNotNull() & ~F.col("s").rlike("[.!?。][.!?。]"))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), cl.shown_text(F.col("s")).alias("shown"))


@query("select row_no, count(*) as items from (select row_no, unnest(string_split_regex(coalesce(ppeSummary, ''), '\\s*(?:\\n+|[;；]|ㆍ|•)\\s*')) as x from msds_sample) where trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '' group by row_no")
def scl42_display_items(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "msds_sample").select("row_no", F.size(cl.display_items(F.col("ppeSummary"))).cast("bigint").alias("items"))
    return s.where("items > 0")


@query("""select row_no, pos, n, case when n > 1 then len(regexp_extract_all(upper(s), 'H[0-9]{3}(?:\\+H?[0-9]{3})*')) else 1 end as parts from (select row_no, pos, s, len(regexp_extract_all(upper(s), 'H[0-9]{3}(?:\\+H?[0-9]{3})*')) as n from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample) where s is not null)""")
def scl13_split_codes(spark: SparkSession, d: str) -> DataFrame:
    """Into how many statements a text with several codes is cut."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s")).where("s is not null")
    n = F.size(F.regexp_extract_all(F.upper("s"), F.lit(r"H[0-9]{3}(?:\+H?[0-9]{3})*"), F.lit(0)))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), n.cast("bigint").alias("n"), F.size(cl.by_codes(F.col("s"), "H")).cast("bigint").alias("parts"))


@query(f"""select row_no, pos, regexp_replace(regexp_extract(v, '([HP][0-9]{{3}}(?:\\s*\\+\\s*[HP]?[0-9]{{3}})*)', 1), '\\s', '', 'g') as code,
  {_SP("regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[HP][0-9]{3}(?:\\s*\\+\\s*[HP]?[0-9]{3})*', ' ', 'g'), '^\\s*(?:[-–—•·*:：]\\s*)+', ''), '^\\s*(?:예방|대응|저장|폐기)\\s*[:：-]\\s*', ''), '^\\s*(?:[-–—•·*:：]\\s*)+', '')")} as body
  from (select row_no, generate_subscripts(precautionaryStatements.prevention, 1) as pos, {_SP("unnest(precautionaryStatements.prevention)")} as v from msds_sample)""")
def scl14_statements(spark: SparkSession, d: str) -> DataFrame:
    """Code and text of every prevention statement."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("precautionaryStatements.prevention").alias("p", "s"))
    x = cl.statement(F.col("s"))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), x.getField("code").alias("code"), x.getField("text").alias("body"))


_TOK = f"list_filter(string_split({_SP('s')}, ' '), lambda x: x <> '')"
_FLAGS = f"array_to_string(list_transform({_TOK}, lambda x: case when length(regexp_replace(x, '[^가-힣]', '', 'g')) = 1 then 's' else 'm' end), '')"
_HW = f"list_filter({_TOK}, lambda x: regexp_matches(x, '[가-힣]'))"
_HS = f"list_filter(list_transform({_TOK}, lambda x: regexp_replace(x, '[^가-힣]', '', 'g')), lambda x: x <> '')"


@query(f"""select row_no, pos, len({_HW}) >= 6 and length(replace({_FLAGS}, 'm', '')) * 2 >= len({_HW}) and contains({_FLAGS}, 'ssss') as letter_spaced, contains({_FLAGS}, 'sss') as oddly_spaced,
  length(array_to_string({_HS}, '')) >= 6 and length(array_to_string({_HS}, '')) > 5 * len({_HS}) as run_together from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample)""")
def scl16_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Statements with too many blanks, or hardly any."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s"))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), cl.letter_spaced(F.col("s")).alias("letter_spaced"), cl.oddly_spaced(F.col("s")).alias("oddly_spaced"), cl.run_together(F.col("s")).alias("run_together"))


_V17 = "regexp_replace(coalesce(s, ''), '[\\s.)]+$', '')"


@query(f"""select row_no, pos, v = '' or (right(v, 1) between '가' and '힣' and (unicode(right(v, 1)) - 44032) % 28 = 16 and not regexp_matches(v, '(?:{'|'.join(cl.M_NOUNS)})$')) or regexp_matches(v, '(?:{'|'.join(cl.ENDINGS)})$') or not right(v, 1) between '가' and '힣' as ends
  from (select row_no, pos, {_V17} as v from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample))""")
def scl17_sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s"))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), cl.ends_sentence(F.col("s")).alias("ends"))


_PARTS = f"list_filter(string_split_regex({_SP('emergencyContact')}, '\\s*[/|·]\\s*'), lambda x: x <> '')"
_VAL = "trim(regexp_replace(x, '^[^:：]{0,26}[:：]\\s*', ''))"
_PICK = lambda cond: f"coalesce(list_filter(list_transform(list_filter({_PARTS}, lambda x: {cond}), lambda x: {_VAL}), lambda x: x <> '')[1], '')"
_URGENT = "regexp_matches(x, '(?i)긴급|젂급|응급|emergency')"


@query(f"select row_no, case when e = '' then '' else p end as phone, case when e = '' then p else e end as emergency from (select row_no, {_PICK('not ' + _URGENT)} as p, {_PICK(_URGENT)} as e from msds_sample)")
def scl22_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Phone and emergency number of a contact field."""
    x = cl.contacts(F.col("emergencyContact"))
    return table(spark, d, "msds_sample").select("row_no", x.getField("phone").alias("phone"), x.getField("emergency").alias("emergency"))


_RAW = "regexp_extract(emergencyContact, '(?:^|[^0-9-])(0[0-9]{1,2}[\\s)\\-.]{1,3}[0-9]{3,4}[\\s\\-.]{1,3}[0-9]{4})(?:$|[^0-9-])', 1)"


@query(f"select row_no, case when n = '' then '' when starts_with(n, '02') then '02-' || substr(n, 3, length(n) - 6) || '-' || right(n, 4) else left(n, 3) || '-' || substr(n, 4, length(n) - 7) || '-' || right(n, 4) end as phone from (select row_no, coalesce(regexp_replace({_RAW}, '[^0-9]', '', 'g'), '') as n from msds_sample)")
def scl22_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", cl.phone(F.col("emergencyContact")).alias("phone"))


@query(f"""select row_no, item_no, case when s <> '' then regexp_replace(s, '\\s*[~\\-–]\\s*', '~') when b <> '' then regexp_replace(b, '\\s', '', 'g') when p <> '' then p || '%' || case when w <> '' then ' ' || w else '' end else '' end as amount
  from (select row_no, item_no, regexp_extract(v, '([0-9]+(?:\\.[0-9]+)?)\\s*[~\\-–]\\s*([0-9]+(?:\\.[0-9]+)?)') as s, regexp_extract(v, '[<>≤≥]\\s*[0-9]+(?:\\.[0-9]+)?') as b, regexp_extract(v, '(?:^|[^0-9\\-.])([0-9]+(?:\\.[0-9]+)?)\\s*%', 1) as p, regexp_extract(v, '이상|이하') as w
  from (select row_no, item_no, {_SP('content')} as v from msds_ingredient))""")
def scl23_amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", cl.amount(F.col("content")).alias("amount"))


@query(f"select doc_id, sha256(coalesce(text, '')) as digest, sha256({_WORD("coalesce(text, '')")}) as fingerprint from documents where doc_kind <> 'sheet' and regexp_full_match(coalesce(text, ''), '[\\x00-\\x7f가-힣]*')")
def scl24_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a text and of its letters and digits; texts of plain letters only, whose lower case all engines share."""
    t = F.coalesce("text", F.lit(""))
    s = table(spark, d, "documents").where((F.col("doc_kind") != "sheet") & t.rlike(r"^[\x00-\x7f가-힣]*$(?!\n)"))
    return s.select("doc_id", F.sha2(t, 256).alias("digest"), F.sha2(keys.word_key(t), 256).alias("fingerprint"))


_PE = """case when v = '' then 'PDF_PATH_MISSING' when regexp_matches(v, '^https?://') or not starts_with(r, 'pdf/') or regexp_matches(r, '(^|/)\\.\\.?(/|$)') or not regexp_matches(r, '(?i)[^/]\\.pdf$') then 'PDF_PATH_INVALID' when p is null then 'PDF_FILE_NOT_FOUND' end"""


@query(f"""select row_no, {_PE} as problem from (select row_no, v, regexp_replace(v, '^/+', '') as r, p from (select row_no, replace(trim(coalesce(pdfPath, '')), '\\', '/') as v from msds_sample) left join (select distinct regexp_replace(pdfPath, '^/+', '') as p from pdf_inventory) on p = regexp_replace(v, '^/+', '')) where {_PE} is not null""")
def scl25_path_problems(spark: SparkSession, d: str) -> DataFrame:
    """Paths that are missing, unsafe, or without a file."""
    files = table(spark, d, "pdf_inventory").select(F.regexp_replace("pdfPath", "^/+", "").alias("p")).distinct()
    r = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("pdfPath", F.lit(""))), r"\\", "/"), "^/+", "")
    s = table(spark, d, "msds_sample").join(files, r == F.col("p"), "left")
    return s.select("row_no", F.coalesce(cl.path_error(F.col("pdfPath")), F.when(F.col("p").isNull(), "PDF_FILE_NOT_FOUND")).alias("problem")).where("problem is not null")


@query("select row_no, replace(replace(replace(replace(replace(coalesce(emergencyContact, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from msds_sample")
def scl26_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", cl.html(F.col("emergencyContact")).alias("escaped"))


@query(f"select row_no, item_no, case when v = '' then null when regexp_matches(v, '^[○Oo●ㅇ]|^해당($|[^ 없]| [^없])|^대상') then '○' when regexp_matches(v, '없음|아님|^[-×xX]') then '' else '?' end as flag from (select row_no, item_no, {_SP('managementTarget')} as v from msds_ingredient)")
def scl27_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", cl.flag_value(F.col("managementTarget")).alias("flag"))


_CORE = lambda c: _WORD(f"regexp_replace(regexp_replace(coalesce({c}, ''), '[(（\\[][^)）\\]]*[)）\\]]?', '', 'g'), '[/;,].*$', '')")


@query(f"""select row_no, item_no, coalesce(x <> '' and (x = y or (least(length(x), length(y)) >= 3 and (contains(x, y) or contains(y, x)))), false) as same from (select i.row_no, i.item_no, {_CORE('i.chemicalName')} as x, {_CORE('r.chemicalName')} as y from msds_ingredient i join substance_ref r on r.casNo = trim(i.casNo))""")
def scl28_same_substance(spark: SparkSession, d: str) -> DataFrame:
    """Whether a line's name and the reference name of its number are of the same substance."""
    r = table(spark, d, "substance_ref").select(F.col("casNo").alias("c"), F.col("chemicalName").alias("ref"))
    return table(spark, d, "msds_ingredient").join(r, F.trim("casNo") == F.col("c")).select("row_no", "item_no", cl.same_substance(F.col("chemicalName"), F.col("ref")).alias("same"))


@query("select i.row_no, i.item_no, coalesce(r.chemicalName, i.chemicalName) as shown, r.chemicalName is not null and r.chemicalName is distinct from i.chemicalName as replaced from msds_ingredient i left join substance_ref r on r.casNo = trim(i.casNo)")
def scl29_reference_names(spark: SparkSession, d: str) -> DataFrame:
    """Names replaced by the reference name of their number."""
    r = table(spark, d, "substance_ref").select(F.col("casNo").alias("c"), F.col("chemicalName").alias("ref"))
    j = table(spark, d, "msds_ingredient").join(r, F.trim("casNo") == F.col("c"), "left")
    return j.select("row_no", "item_no", F.coalesce("ref", "chemicalName").alias("shown"), (F.col("ref").isNotNull() & ~F.col("ref").eqNullSafe(F.col("chemicalName"))).alias("replaced"))


_GLYPHS = {"싞": "신", "벖": "벗", "얶": "언", "젂": "전", "핚": "한", "짂": "진", "갂": "간"}


@query(f"select doc_id, length(text) as n, translate(left(text, 200), '{''.join(_GLYPHS)}', '{''.join(_GLYPHS.values())}') as fixed from documents where text is not null")
def scl30_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Broken glyphs put right by a map of characters; the result shows the beginning, the length is that of the whole."""
    t = F.translate("text", "".join(_GLYPHS), "".join(_GLYPHS.values()))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).cast("bigint").alias("n"), F.substring(t, 1, 200).alias("fixed"))


_CN = _SP(f"regexp_replace({_SP('chemicalName')}, '(?i)^(?:[-·•○]\\s*)*(?:화학물질명|물질명|성분명|관용명|이명)\\s*[:：]?\\s*', '')")


@query(f"select row_no, item_no, case when regexp_matches({_CN}, '(?i)^(?:cas\\s*(?:no\\.?|번호)?|함유량.*|자료\\s*없음|해당\\s*없음|[0-9.,%~<>\\s-]*)$') then '' else {_CN} end as name, regexp_replace(trim(coalesce(casNo, '')), '\\s*[-–—]\\s*', '-', 'g') as cas from msds_ingredient")
def scl33_components(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", cl.component_name(F.col("chemicalName")).alias("name"), cl.clean_cas(F.col("casNo")).alias("cas"))


_JV = _SP("chemicalName")


@query(f"""select row_no, item_no, reason from (select row_no, item_no, case when v = '' then 'blank' when regexp_matches(v, '(?i)^(?:화학물질명|물질명|성분|cas|함유량|관용명)') then 'header' when regexp_matches(v, '(?i)page\\s*[0-9]|[0-9]+\\s*/\\s*[0-9]+\\s*(?:페이지|쪽)?$') then 'page'
  when regexp_full_match(v, '[0-9.,\\s-]+') then 'number' when length(regexp_replace(v, '[^(（]', '', 'g')) <> length(regexp_replace(v, '[^)）]', '', 'g')) then 'brackets' when regexp_matches(v, '[0-9]\\s*%') then 'percent' end as reason from (select row_no, item_no, {_JV} as v from msds_ingredient)) where reason is not null""")
def flt17_junk_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", cl.junk_name(F.col("chemicalName")).alias("reason")).where("reason is not null")


_BAD = "싞늒맊홖젂핚짂갂숚렦맋핛젗벖첛얶옦젘앆젃"


@query(f"select doc_id, length(regexp_replace(coalesce(text, ''), '[^가-힣]', '', 'g')) >= 200 and length(regexp_replace(coalesce(text, ''), '[^{_BAD}]', '', 'g')) >= 0.005 * length(regexp_replace(coalesce(text, ''), '[^가-힣]', '', 'g')) as broken from documents")
def flt16_broken_fonts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", cl.broken_font(F.col("text")).alias("broken"))


@query(f"select row_no, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(coalesce(fileName, '')), '[\\s()\\[\\]{{}}<>_\\-/\\\\.,:;]+')), lambda x: length(x) >= 2 and x not in ({', '.join(repr(w) for w in cl.FILE_WORDS)}))), ',') as tokens from msds_sample")
def scl6_file_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The words of a file name that can tell products apart."""
    parts = F.array_distinct(F.split(F.lower(F.coalesce("fileName", F.lit(""))), r"[\s()\[\]{}<>_\-/\\.,:;]+"))
    kept = F.array_except(F.filter(parts, lambda x: F.length(x) >= 2), F.array(*[F.lit(w) for w in cl.FILE_WORDS]))
    return table(spark, d, "msds_sample").select("row_no", F.array_join(F.array_sort(kept), ",").alias("tokens"))


@query(r"""select doc_id, count(*) as identifiers from (select doc_id, unnest(string_split_regex(regexp_replace(text, '([0-9]{4}-[0-9]{2}-)\s+([0-9]{2}\))', '\1\2', 'g'), '[^0-9A-Za-z_()-]+')) as t from documents where text is not null)
  where regexp_full_match(t, 'T-[0-9]{4}-[0-9]+(\([0-9]{4}-[0-9]{2}-[0-9]{2}\))?|KE-[0-9]+|Z[0-9]+-[0-9]+|[0-9]{2,4}-[0-9]-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]') group by doc_id""")
def scl3_source_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of documents that are no registry numbers, with dates that a line break had parted."""
    t = F.regexp_replace("text", r"([0-9]{4}-[0-9]{2}-)\s+([0-9]{2}\))", "$1$2")
    tokens = F.split(t, "[^0-9A-Za-z_()-]+")
    hit = r"^(T-[0-9]{4}-[0-9]+(\([0-9]{4}-[0-9]{2}-[0-9]{2}\))?|KE-[0-9]+|Z[0-9]+-[0-9]+|[0-9]{2,4}-[0-9]-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9])$"
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(tokens, lambda x: x.rlike(hit))).cast("bigint").alias("identifiers")).where("identifiers > 0")


@query("select doc_id, count(*) as rows, count(*) filter (len(p) > 1) as pairs from (select doc_id, string_split_regex(trim(l), '\\s{3,}|\\t') as p from (select doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null) where regexp_matches(l, '[^ \\t\\r]')) group by doc_id")
def scl36_label_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a label and a value with a column gap between them."""
    l = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"[^ \t\r]"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size(F.split(F.trim("l"), r"\s{3,}|\t")) > 1).alias("pairs"))


@query(f"select row_no, pos, regexp_replace(regexp_replace({_SP('s')}, '^[-•·*○●▪]+\\s*', ''), '[\\s,;·]+$', '') as line from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample)")
def scl37_tidy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without bullets before and stray marks behind."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s"))
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), F.regexp_replace(F.regexp_replace(cl.spaces(F.col("s")), r"^[-•·*○●▪]+\s*", ""), r"[\s,;·]+$", "").alias("line"))


_LABELS = "유해위험문구|유해위험|위험문구|예방조치문구|예방조치|예방|대응|저장|폐기|신호어|그림문자|분류|문구"


@query(f"select row_no, pos, regexp_full_match(regexp_replace(regexp_replace(s, '^\\s*(?:\\(?[0-9]{{1,2}}[).．]|[가나다라마바사아자차카타파하][.)．])\\s*', ''), '[^가-힣A-Za-z]', '', 'g'), '(?:{_LABELS})*') as is_label from (select row_no, generate_subscripts(precautionaryStatements.prevention, 1) as pos, unnest(precautionaryStatements.prevention) as s from msds_sample) where s is not null")
def scl38_label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold only the words of labels."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("precautionaryStatements.prevention").alias("p", "s")).where("s is not null")
    flat = F.regexp_replace(F.regexp_replace("s", r"^\s*(?:\(?[0-9]{1,2}[).．]|[가나다라마바사아자차카타파하][.)．])\s*", ""), "[^가-힣A-Za-z]", "")
    return s.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), flat.rlike(f"^(?:{_LABELS})*$").alias("is_label"))


_PHONE35 = "regexp_extract(v, '(?:전화|tel|연락처)[^0-9]{0,20}([0-9][0-9 ()-]{6,}[0-9])', 1)"


@query(f"""select doc_id, regexp_extract(v, '(?:회사명|제조사|공급자)\\s*[:：]\\s*([^\\n]{{1,80}})', 1) as company, {_PHONE35} as phone, regexp_extract(v, '(?:개정일자?|개정일)\\s*[:：]\\s*([^\\n]{{1,40}})', 1) as revised from (select doc_id, text as v from documents where text is not null)""")
def scl35_basic_fields(spark: SparkSession, d: str) -> DataFrame:
    """Company, phone and revision of a document from labelled lines."""
    v = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract(v, r"(?:회사명|제조사|공급자)\s*[:：]\s*([^\n]{1,80})", 1).alias("company"), F.regexp_extract(v, r"(?:전화|tel|연락처)[^0-9]{0,20}([0-9][0-9 ()-]{6,}[0-9])", 1).alias("phone"), F.regexp_extract(v, r"(?:개정일자?|개정일)\s*[:：]\s*([^\n]{1,40})", 1).alias("revised"))


# projections


@query(f"""select row_no, coalesce(productName, '') as productName, coalesce(nullif(pdfPath, ''), case when coalesce(fileName, '') <> '' then 'pdf/' || fileName else '' end) as pdfPath, coalesce(useCategory, '') as useCategory,
  {", ".join(f"len(coalesce(precautionaryStatements.{p}, [])) as n_{p}" for p in LISTS)}, len(coalesce(ghsCodes, [])) as n_codes from msds_sample""")
def prj10_normal_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with defaults for missing fields: empty texts, empty lists, a path from the file name."""
    e = lambda c: F.coalesce(c, F.lit(""))
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("bigint")
    path = F.coalesce(F.nullif("pdfPath", F.lit("")), F.when(e("fileName") != "", F.concat(F.lit("pdf/"), "fileName")).otherwise(""))
    return table(spark, d, "msds_sample").select("row_no", e("productName").alias("productName"), path.alias("pdfPath"), e("useCategory").alias("useCategory"), *[size(F.col(f"precautionaryStatements.{p}")).alias(f"n_{p}") for p in LISTS], size(F.col("ghsCodes")).alias("n_codes"))


@query("""select override_no, case when reviewStatus in ('검토필요', '자동추출', '승인', '보류', '수정필요', '제외') then reviewStatus else '검토필요' end as status, coalesce(nullif(matchTarget.fileName, ''), list_extract(string_split(replace(sourcePdfPath, '\\', '/'), '/'), -1), '') as file,
  coalesce(signalWordCandidate, '') as signal, len(coalesce(ppeCandidates, [])) as n_ppe from msds_overrides""")
def prj11_normal_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with defaults, and their status clamped to the known ones."""
    status = F.when(F.col("reviewStatus").isin("검토필요", "자동추출", "승인", "보류", "수정필요", "제외"), F.col("reviewStatus")).otherwise("검토필요")
    file = F.coalesce(F.nullif(F.col("matchTarget.fileName"), F.lit("")), keys.base_name(F.col("sourcePdfPath")), F.lit(""))
    return table(spark, d, "msds_overrides").select("override_no", status.alias("status"), file.alias("file"), F.coalesce("signalWordCandidate", F.lit("")).alias("signal"), F.size(F.coalesce("ppeCandidates", F.array().cast("array<string>"))).cast("bigint").alias("n_ppe"))


PUBLIC = ("id", "productName", "supplier", "msdsNo", "fileName", "pdfPath", "revisionDate", "signalWord", "noSuchField")


@query(f"select {', '.join(c for c in PUBLIC if c != 'noSuchField')} from msds_sample")
def prj12_public_fields(spark: SparkSession, d: str) -> DataFrame:
    """Only the fields of the public list, those that there are."""
    s = table(spark, d, "msds_sample")
    return s.select(*[c for c in PUBLIC if c in s.columns])


@query("""select override_no, case when coalesce(trim(signalWordCandidate), '') in ('', '위험', '경고', '해당없음') then signalWordCandidate end as signal, case when coalesce(revisionDateCandidate, '') = '' or (regexp_full_match(trim(revisionDateCandidate), '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(trim(revisionDateCandidate) as date) is not null) then revisionDateCandidate end as revised from msds_overrides""")
def prj13_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the fields that raise a warning."""
    v = F.trim("revisionDateCandidate")
    sound = (F.coalesce("revisionDateCandidate", F.lit("")) == "") | (v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull())
    return table(spark, d, "msds_overrides").select("override_no", F.when(F.coalesce(F.trim("signalWordCandidate"), F.lit("")).isin("", "위험", "경고", "해당없음"), F.col("signalWordCandidate")).alias("signal"), F.when(sound, F.col("revisionDateCandidate")).alias("revised"))


@query("""select row_no, case when trim(coalesce(msdsNo, '')) <> '' then trim(msdsNo) when hazardNotClassified then '필요 없음' else '-' end as shown from msds_sample""")
def prj16_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.trim(F.coalesce("msdsNo", F.lit("")))
    return table(spark, d, "msds_sample").select("row_no", F.when(v != "", v).when(F.col("hazardNotClassified"), "필요 없음").otherwise("-").alias("shown"))


@query("""select row_no, array_to_string(k[1:2], ' / ') || case when len(k) > 0 and len(h) - least(len(k), 2) > 0 then ' 외 ' || (len(h) - least(len(k), 2)) || '건' else '' end as summary from (select row_no, coalesce(hazardStatements, []) as h, list_filter(coalesce(hazardStatements, []), lambda x: x <> '') as k from msds_sample)""")
def prj17_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first two hazard statements, and how many more there are."""
    return table(spark, d, "msds_sample").select("row_no", cl.summarised(F.col("hazardStatements"), 2, " / ").alias("summary"))


@query(f"""select row_no, case when coalesce(id, '') <> '' then id when coalesce(msdsNo, '') <> '' then {_WORD('msdsNo')} else {_WORD('coalesce(fileName, productName, cast(row_no as varchar))')} end as stable_id from msds_sample""")
def prj18_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id from the first identity that an entry has."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return table(spark, d, "msds_sample").select("row_no", F.coalesce(filled("id"), keys.word_key(filled("msdsNo")), keys.word_key(F.coalesce("fileName", "productName", F.col("row_no").cast("string")))).alias("stable_id"))


_WHO = f"trim(regexp_replace(trim(regexp_replace(coalesce(supplier, ''), '{cl.LEGAL}', '', 'g')), '\\s+(?:본사|\\S*공장)$', ''))"
_SAFE = lambda c: "regexp_replace(" + _SP(f"regexp_replace({c}, '[\\\\/:*?\"<>|]', '-', 'g')") + ", '\\.+$', '')"


@query(f"""select row_no, {_SAFE('who')} || '_' || {_SAFE("case when starts_with(lower(what), lower(who) || ' ') then trim(substr(what, length(who) + 2)) else what end")} || '_MSDS_' || case when length(day) = 8 then day else '날짜없음' end || '.pdf' as file
  from (select row_no, case when {_WHO} = '' then '회사미상' else {_WHO} end as who, trim(coalesce(productName, '')) as what, regexp_replace(coalesce(revisionDate, ''), '[^0-9]', '', 'g') as day from msds_sample)""")
def prj19_standard_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", cl.standard_file(F.col("supplier"), F.col("productName"), F.col("revisionDate")).alias("file"))


@query(f"""with c as (select row_no, array_to_string(list_sort(list(c order by item_no, c)[1:5]), ',') as cas from (select row_no, min(item_no) as item_no, trim(casNo) as c from msds_ingredient where trim(casNo) <> '' group by row_no, trim(casNo)) group by row_no)
  select s.row_no, {_SEARCH("coalesce(productName, '')")} || '|' || {_SEARCH("coalesce(supplier, '')")} || '|' || coalesce(cas, '') as signature from msds_sample s left join c using (row_no)""")
def prj21_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Name, supplier and the first five registry numbers of an entry, cut first and then sorted."""
    i = table(spark, d, "msds_ingredient").select("row_no", F.trim("casNo").alias("c"), "item_no").where("c <> ''").groupBy("row_no", "c").agg(F.min("item_no").alias("item_no"))
    cas = i.groupBy("row_no").agg(F.array_join(F.array_sort(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "c"))), lambda x: x.c), 1, 5)), ",").alias("cas"))
    k = lambda c: keys.search_key(F.coalesce(c, F.lit("")))
    return table(spark, d, "msds_sample").join(cas, "row_no", "left").select("row_no", F.concat_ws("|", k("productName"), k("supplier"), F.coalesce("cas", F.lit(""))).alias("signature"))


@query(f"""with o as (select productId, first(productNameCandidate order by override_no) as n, first(supplierCandidate order by override_no) as s from msds_overrides where productId is not null group by 1)
  select row_no, coalesce(nullif(trim(o.n), ''), nullif(trim(productName), ''), nullif({_SP(_FILE)}, ''), 'MSDS') as name, coalesce(nullif(trim(supplier), ''), nullif(trim(o.s), ''), nullif(trim(siteLabel), ''), '기타 업체') as company from msds_sample left join o on o.productId = id""")
def prj22_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Name and company of an entry from the first source that has them."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy("productId").agg(F.min_by("productNameCandidate", "override_no").alias("n"), F.min_by("supplierCandidate", "override_no").alias("s"))
    j = table(spark, d, "msds_sample").join(o, F.col("id") == F.col("productId"), "left")
    f = keys.first_filled
    return j.select("row_no", F.coalesce(f(F.col("n"), F.col("productName"), cl.product_of_file(F.col("fileName"))), F.lit("MSDS")).alias("name"), F.coalesce(f(F.col("supplier"), F.col("s"), F.col("siteLabel")), F.lit("기타 업체")).alias("company"))


@query("""with o as (select productId, bool_or(len(ghsCodes) > 0 or coalesce(signalWordCandidate, '') <> '') as usable from msds_overrides where productId is not null and reviewStatus <> '제외' group by 1)
  select row_no, case when coalesce(usable, false) then 'document' when coalesce(len(hazardStatements), 0) > 0 or coalesce(len(ghsCodes), 0) > 0 then 'entry' else 'none' end as card from msds_sample left join o on o.productId = id""")
def prj23_cards(spark: SparkSession, d: str) -> DataFrame:
    """Which of three cards an entry shows: its document's, its own, or none."""
    usable = (F.size("ghsCodes") > 0) | (F.coalesce("signalWordCandidate", F.lit("")) != "")
    o = table(spark, d, "msds_overrides").where("productId is not null and reviewStatus <> '제외'").groupBy("productId").agg(F.bool_or(usable).alias("usable"))
    own = (F.coalesce(F.size("hazardStatements"), F.lit(0)) > 0) | (F.coalesce(F.size("ghsCodes"), F.lit(0)) > 0)
    return table(spark, d, "msds_sample").join(o, F.col("id") == F.col("productId"), "left").select("row_no", F.when(F.coalesce("usable", F.lit(False)), "document").when(own, "entry").otherwise("none").alias("card"))


@query("select row_no, '?product=' || url_encode(id) || case when coalesce(productName, '') <> '' then '&q=' || replace(url_encode(productName), '%20', '+') else '' end as link from msds_sample where id is not null and regexp_full_match(coalesce(productName, ''), '[0-9A-Za-z가-힣 ]*')")
def prj24_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that carry the id and the name, so a retired id can be found by name."""
    s = table(spark, d, "msds_sample").where(F.col("id").isNotNull() & F.coalesce("productName", F.lit("")).rlike("^[0-9A-Za-z가-힣 ]*$"))
    q = F.when(F.coalesce("productName", F.lit("")) != "", F.concat(F.lit("&q="), F.url_encode("productName"))).otherwise("")
    return s.select("row_no", F.concat(F.lit("?product="), F.url_encode("id"), q).alias("link"))


@query(f"select row_no, regexp_replace(lower(regexp_replace(coalesce(fileName, ''), '(?i)\\.pdf$', '')), '[\\s()\\[\\]{{}}<>_\\-/\\\\.,:;]+', '', 'g') as k_file, {_WORD('erpName')} as k_erp, {_WORD('msdsNo')} as k_number from msds_sample")
def prj26_match_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("fileName", F.lit("")), r"(?i)\.pdf$", "")), r"[\s()\[\]{}<>_\-/\\.,:;]+", "").alias("k_file"), keys.word_key(F.col("erpName")).alias("k_erp"), keys.word_key(F.col("msdsNo")).alias("k_number"))


@query("select inventoryStatus, inventory_no, fileName from (select *, row_number() over (partition by inventoryStatus order by inventory_no) as r from pdf_inventory) where r <= 5")
def prj27_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five examples of every status. The five least are kept by a partial step in every task, so no status is gathered."""
    p = table(spark, d, "pdf_inventory").select("inventoryStatus", F.struct("inventory_no", "fileName").alias("x"))
    from pyspark.sql import Window

    w = Window.partitionBy("__p", "inventoryStatus").orderBy("x")
    first = p.withColumn("__p", F.spark_partition_id()).withColumn("r", F.row_number().over(w)).where("r <= 5")
    least = first.groupBy("inventoryStatus").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 5).alias("xs"))
    return least.select("inventoryStatus", F.explode("xs").alias("x")).select("inventoryStatus", "x.inventory_no", "x.fileName")


@query("select row_no, item_no, coalesce(nullif(trim(chemicalName), ''), '') as name, coalesce(nullif(trim(casNo), ''), '') as cas, coalesce(nullif(trim(content), ''), '') as content from msds_ingredient where coalesce(trim(chemicalName), '') <> '' or coalesce(trim(casNo), '') <> '' or coalesce(trim(content), '') <> ''")
def prj28_ingredient_rows(spark: SparkSession, d: str) -> DataFrame:
    v = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", v("chemicalName").alias("name"), v("casNo").alias("cas"), v("content").alias("content")).where("name <> '' or cas <> '' or content <> ''")


@query(f"select override_no, coalesce(nullif(regexp_replace(replace(trim(matchTarget.relativePath), '\\', '/'), '^/+', ''), ''), nullif(trim(matchTarget.fileName), ''), '') as key, coalesce(nullif(trim(matchTarget.fileName), ''), {_BASE('sourcePdfPath')}, '') as file from msds_overrides")
def prj29_document_keys(spark: SparkSession, d: str) -> DataFrame:
    f = F.nullif(F.trim("matchTarget.fileName"), F.lit(""))
    return table(spark, d, "msds_overrides").select("override_no", F.coalesce(F.nullif(keys.path_key(F.col("matchTarget.relativePath")), F.lit("")), f, F.lit("")).alias("key"), F.coalesce(f, keys.base_name(F.col("sourcePdfPath")), F.lit("")).alias("file"))


@query("select inventory_no, array_to_string(list_sort(list_distinct(list_filter([p, regexp_replace(p, '^pdf/', ''), 'pdf/' || regexp_replace(p, '^pdf/', '')], lambda x: x <> '' and x <> 'pdf/'))), '|') as variants from (select inventory_no, lower(regexp_replace(replace(trim(coalesce(pdfPath, '')), '\\', '/'), '^/+', '')) as p from pdf_inventory)")
def prj30_path_variants(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower(keys.path_key(F.coalesce("pdfPath", F.lit(""))))
    bare = F.regexp_replace(p, "^pdf/", "")
    return table(spark, d, "pdf_inventory").select("inventory_no", F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(p, bare, F.concat(F.lit("pdf/"), bare)), lambda x: (x != "") & (x != "pdf/")))), "|").alias("variants"))


_ALLP = ", ".join(f"coalesce(precautionaryStatements.{p}, [])" for p in LISTS)


@query(f"select row_no, array_to_string(list_filter(list_transform(flatten([{_ALLP}]), lambda x: trim(regexp_replace(x, '^[-\\s]+', ''))), lambda x: x <> ''), '|') as precautions, array_to_string(list_sort(list_distinct(list_transform(coalesce(ghsCodes, []), lambda x: upper(x)))), ',') as codes from msds_sample")
def prj31_list_views(spark: SparkSession, d: str) -> DataFrame:
    """All precautions of an entry in one list, and its codes."""
    none = F.array().cast("array<string>")
    flat = F.flatten(F.array(*[F.coalesce(F.col(f"precautionaryStatements.{p}"), none) for p in LISTS]))
    items = F.filter(F.transform(flat, lambda x: F.trim(F.regexp_replace(x, r"^[-\s]+", ""))), lambda x: x != "")
    return table(spark, d, "msds_sample").select("row_no", F.array_join(items, "|").alias("precautions"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("ghsCodes", none), F.upper))), ",").alias("codes"))


@query("""select row_no, lower(regexp_replace('제품명 (Product Name)', '\\s+', '', 'g')) as header, strftime(loaded_at, '%Y-%m-%d') as loaded from msds_sample""")
def prj25_sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """A header squeezed and a time cell as a day, as a spreadsheet row gives them."""
    return table(spark, d, "msds_sample").select("row_no", F.lower(F.regexp_replace(F.lit("제품명 (Product Name)"), r"\s+", "")).alias("header"), F.date_format("loaded_at", "yyyy-MM-dd").alias("loaded"))
