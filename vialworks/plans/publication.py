"""Queries of merging, publishing and checking over a catalogue folder, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.functions import cleaning as cl
from vialworks.functions import keys, text
from vialworks.operators import catalogue as op
from vialworks.plans.catalogue import _BASE, _CAS, _SEARCH, query
from vialworks.plans.relations import _TOP, _register, phrases, usual_phrases
from vialworks.sources.tables import table

#: Review states that keep a document's values against a newer reading.
LOCKED = ["검토완료", "승인", "수정필요", "제외"]
#: Hazard codes that go with the signal word for danger only.
DANGER_ONLY = "H220 H222 H224 H225 H230 H231 H250 H260 H270 H271 H300 H301 H304 H310 H311 H314 H318 H330 H331 H334 H340 H350 H360 H370 H372".split()
SIGNALS = ["", "위험", "경고", "해당없음"]
_LOCK = "', '".join(LOCKED)
_ISO = lambda c: f"(regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(trim({c}) as date) is not null)"


def iso(c: Column) -> Column:
    v = F.trim(c)
    return F.coalesce(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


_STATES = """s as (select matchTarget.relativePath as path, min(override_no) as a, max(override_no) as z from msds_overrides where matchTarget.relativePath <> '' group by 1)"""


def _states(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first and the last reading of every file, as structs."""
    o = table(spark, d, "msds_overrides").withColumn("path", F.col("matchTarget.relativePath")).where("path <> ''")
    row = F.struct("override_no", *columns)
    return o.groupBy("path").agg(F.min(row).alias("old"), F.max(row).alias("new"))


@query(f"""with {_STATES} select path, case when a = z then 'created' else 'updated' end as action, case when o.reviewStatus in ('{_LOCK}') then o.supplierCandidate else coalesce(n.supplierCandidate, o.supplierCandidate) end as supplier,
  coalesce(o.reviewStatus, n.reviewStatus) as status, n.extractStatus as extractStatus, coalesce(o.reviewedBy, n.reviewedBy) as reviewedBy from s join msds_overrides o on o.override_no = a join msds_overrides n on n.override_no = z""")
def mrg2_merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document's earlier and newer reading merged: locked reviews keep their values, what people entered stays."""
    s = _states(spark, d, "supplierCandidate", "reviewStatus", "extractStatus", "reviewedBy")
    locked = F.col("old.reviewStatus").isin(*LOCKED)
    return s.select(
        "path", F.when(F.col("old.override_no") == F.col("new.override_no"), "created").otherwise("updated").alias("action"), F.when(locked, F.col("old.supplierCandidate")).otherwise(F.coalesce("new.supplierCandidate", "old.supplierCandidate")).alias("supplier"),
        F.coalesce("old.reviewStatus", "new.reviewStatus").alias("status"), "new.extractStatus", F.coalesce("old.reviewedBy", "new.reviewedBy").alias("reviewedBy"),
    )


@query("""with q as (select matchTarget.relativePath as path, first(reviewStatus order by override_no) as decision, first(reviewedBy order by override_no) as who from msds_overrides where matchTarget.relativePath <> '' group by 1),
  i as (select relativePath as path, min(inventory_no) as inventory_no, first(sha256 order by inventory_no) as sha from pdf_inventory where inventoryStatus = 'unmatched' group by 1)
  select coalesce(i.path, q.path) as path, case when i.path is null then 'missing_from_pdf_library' else 'excel_missing_pdf' end as status, case when decision in ('제외', '보류') then decision else '미검토' end as decision, who, sha from i full join q on i.path = q.path""")
def mrg3_queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The queue of unregistered files: machine fields anew, people's fields kept, unknown decisions reset, gone files marked."""
    q = table(spark, d, "msds_overrides").withColumn("path", F.col("matchTarget.relativePath")).where("path <> ''").groupBy("path").agg(F.min_by(F.struct("reviewStatus", "reviewedBy"), "override_no").alias("q"))
    i = table(spark, d, "pdf_inventory").where("inventoryStatus = 'unmatched'").groupBy(F.col("relativePath").alias("path")).agg(F.min(F.struct("inventory_no", "sha256")).alias("i"))
    kept = F.when(F.col("q.reviewStatus").isin("제외", "보류"), F.col("q.reviewStatus")).otherwise("미검토")
    return i.join(q, "path", "full_outer").select("path", F.when(F.col("i").isNull(), "missing_from_pdf_library").otherwise("excel_missing_pdf").alias("status"), kept.alias("decision"), F.col("q.reviewedBy").alias("who"), F.col("i.sha256").alias("sha"))


@query("""select productId, first(reviewedBy order by override_no) filter (reviewedBy is not null) as reviewedBy, bool_or(reviewStatus = '승인') as approved, count(*) as merged from msds_overrides where productId is not null group by productId having count(*) > 1""")
def mrg4_absorbed_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of duplicate documents absorbed into one: the first reviewer, approved if any was."""
    o = table(spark, d, "msds_overrides").where("productId is not null")
    return o.groupBy("productId").agg(F.min(F.when(F.col("reviewedBy").isNotNull(), F.struct("override_no", "reviewedBy"))).getField("reviewedBy").alias("reviewedBy"), F.bool_or(F.col("reviewStatus") == "승인").alias("approved"), F.count(F.lit(1)).alias("merged")).where("merged > 1")


_REG5 = "reg as (select old as id, first(id order by row_no) as replacedBy from (select row_no, id, unnest(formerIds) as old from msds_sample) group by old)"
_ENTRY = "e as (select productId as id, first(msdsNoCandidate order by override_no) filter (regexp_full_match(msdsNoCandidate, '[A-Z]{2}[0-9]{5}-[0-9]{10}')) as no, first(signalWordCandidate order by override_no) filter (signalWordCandidate in ('위험', '경고', '해당없음')) as signal from msds_overrides where reviewStatus = '승인' and productId is not null group by 1)"


@query(f"""with {_REG5}, {_ENTRY} select s.row_no, coalesce(e.no, s.msdsNo) as msdsNo, case when s.hazardNotClassified then '해당없음' when e.signal is not null then e.signal when trim(s.signalWord) in ('위험', '경고', '해당없음') then trim(s.signalWord) else '' end as signalWord,
  case when s.hazardNotClassified then 0 else coalesce(len(s.hazardStatements), 0) end as hazards, e.no is not null and e.no is distinct from s.msdsNo as number_set from msds_sample s left join e using (id) where s.id not in (select id from reg)""")
def mrg5_register_applied(spark: SparkSession, d: str) -> DataFrame:
    """Entries under the register: retired ones out, approved numbers and signal words set, unclassified ones emptied."""
    o = table(spark, d, "msds_overrides").where("reviewStatus = '승인' and productId is not null")
    first = lambda c, ok: F.min(F.when(ok, F.struct("override_no", F.col(c).alias("v")))).getField("v")
    e = o.groupBy(F.col("productId").alias("__id")).agg(first("msdsNoCandidate", F.col("msdsNoCandidate").rlike("^[A-Z]{2}[0-9]{5}-[0-9]{10}$")).alias("no"), first("signalWordCandidate", F.col("signalWordCandidate").isin("위험", "경고", "해당없음")).alias("signal"))
    s = table(spark, d, "msds_sample").where("id is not null").join(_register(spark, d).select("id"), "id", "left_anti").join(e, F.col("id") == F.col("__id"), "left")
    own = F.when(F.trim("signalWord").isin("위험", "경고", "해당없음"), F.trim("signalWord")).otherwise("")
    return s.select(
        "row_no", F.coalesce("no", "msdsNo").alias("msdsNo"), F.when(F.col("hazardNotClassified"), "해당없음").otherwise(F.coalesce("signal", own)).alias("signalWord"),
        F.when(F.col("hazardNotClassified"), F.lit(0)).otherwise(F.coalesce(F.size("hazardStatements"), F.lit(0))).alias("hazards"), (F.col("no").isNotNull() & ~F.col("no").eqNullSafe(F.col("msdsNo"))).alias("number_set"),
    )


@query(f"""with r as (select {_BASE('pdfPath')} as old, min(relativePath) as new from pdf_inventory where pdfPath <> '' group by 1) select row_no, coalesce('/pdf/' || r.new, pdfPath) as pdfPath, case when r.new is not null and {_BASE('r.new')} <> fileName then {_BASE('r.new')} else fileName end as fileName, r.new is not null and '/pdf/' || r.new <> pdfPath as moved
  from msds_sample s left join r on r.old = {_BASE('s.pdfPath')}""")
def mrg6_followed_renames(spark: SparkSession, d: str) -> DataFrame:
    """Paths replaced by where the file now lies; the file's name follows only if its path did."""
    r = table(spark, d, "pdf_inventory").where("pdfPath <> ''").groupBy(keys.base_name(F.col("pdfPath")).alias("old")).agg(F.min("relativePath").alias("new"))
    s = table(spark, d, "msds_sample").join(r, keys.base_name(F.col("pdfPath")) == F.col("old"), "left")
    new = F.concat(F.lit("/pdf/"), "new")
    base = keys.base_name(F.col("new"))
    return s.select("row_no", F.coalesce(new, "pdfPath").alias("pdfPath"), F.when(base != F.col("fileName"), base).otherwise(F.col("fileName")).alias("fileName"), (F.col("new").isNotNull() & (new != F.col("pdfPath"))).alias("moved"))


@query("""with p as (select row_no, list, pos, trim(s) as s from (select row_no, 'hazard' as list, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample union all select row_no, 'prevention', generate_subscripts(precautionaryStatements.prevention, 1), unnest(precautionaryStatements.prevention) from msds_sample) where trim(s) <> ''),
  c as (select *, regexp_extract(s, '^([HP])[0-9]{3}', 1) as k, substr(s, 2, 1) as g from p) select row_no, list, pos, case when k = 'H' then 'hazard' when k = 'P' then case g when '3' then 'response' when '4' then 'storage' when '5' then 'disposal' else 'prevention' end else list end as target from c""")
def mrg8_rebucketed(spark: SparkSession, d: str) -> DataFrame:
    """Statements under the list that their code belongs to: hazards among precautions and the other way round move."""
    s = table(spark, d, "msds_sample")
    long = s.select("row_no", F.lit("hazard").alias("list"), F.posexplode("hazardStatements").alias("p", "s")).unionByName(s.select("row_no", F.lit("prevention").alias("list"), F.posexplode("precautionaryStatements.prevention").alias("p", "s")))
    v = F.trim("s")
    k, g = F.regexp_extract(v, "^([HP])[0-9]{3}", 1), F.substring(v, 2, 1)
    bucket = F.when(g == "3", "response").when(g == "4", "storage").when(g == "5", "disposal").otherwise("prevention")
    return long.where(v != "").select("row_no", "list", (F.col("p") + 1).cast("bigint").alias("pos"), F.when(k == "H", "hazard").when(k == "P", bucket).otherwise(F.col("list")).alias("target"))


@query("""with o as (select productId, first(ppeCandidates order by override_no) filter (len(ppeCandidates) > 0) as ppe from msds_overrides where productId is not null group by 1) select row_no, case when coalesce(trim(ppeSummary), '') <> '' then ppeSummary else coalesce(array_to_string(ppe, ', '), ppeSummary) end as ppe from msds_sample left join o on o.productId = id""")
def mrg9_filled_from_reports(spark: SparkSession, d: str) -> DataFrame:
    """Blank equipment summaries filled from a document's lines."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min(F.when(F.size("ppeCandidates") > 0, F.struct("override_no", "ppeCandidates"))).getField("ppeCandidates").alias("ppe"))
    s = table(spark, d, "msds_sample").join(o, F.col("id") == F.col("__id"), "left")
    return s.select("row_no", F.when(F.coalesce(F.trim("ppeSummary"), F.lit("")) != "", F.col("ppeSummary")).otherwise(F.coalesce(F.array_join("ppe", ", "), "ppeSummary")).alias("ppe"))


@query("""with r as (select productId, matchTarget.fileName as f, first(supplierCandidate order by override_no) as supplier from msds_overrides where supplierCandidate <> '' group by all) select s.row_no, coalesce(r.supplier, s.supplier) as supplier, r.supplier is not null and r.supplier is distinct from s.supplier as changed from msds_sample s left join r on r.productId = s.id and r.f = s.fileName""")
def mrg10_reference_updates(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers overwritten by a document's where id and file both agree."""
    r = table(spark, d, "msds_overrides").where("supplierCandidate <> ''").groupBy(F.col("productId").alias("p"), F.col("matchTarget.fileName").alias("f")).agg(F.min_by("supplierCandidate", "override_no").alias("v"))
    s = table(spark, d, "msds_sample").join(r, (F.col("id") == F.col("p")) & (F.col("fileName") == F.col("f")), "left")
    return s.select("row_no", F.coalesce("v", "supplier").alias("supplier"), (F.col("v").isNotNull() & ~F.col("v").eqNullSafe(F.col("supplier"))).alias("changed"))


@query("""select fileName, msdsNo, count(distinct id) as ids, min(id) as kept, count(distinct concat_ws('|', coalesce(productName, ''), coalesce(supplier, ''), coalesce(revisionDate, ''))) = 1 as same from msds_sample where fileName <> '' and id is not null group by fileName, msdsNo having count(distinct id) > 1""")
def mrg11_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Ids that share file and number: the one that is kept, and whether their contents are the same (else it's an error)."""
    e = lambda c: F.coalesce(c, F.lit(""))
    s = table(spark, d, "msds_sample").where("fileName <> '' and id is not null")
    return s.groupBy("fileName", "msdsNo").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("kept"), (F.countDistinct(F.concat_ws("|", e("productName"), e("supplier"), e("revisionDate"))) == 1).alias("same")).where("ids > 1")


_WARN = f"""list_filter([case when coalesce(pdfPath, '') = '' then 'PDF_PATH_MISSING' when regexp_matches(pdfPath, '^https?://') or not starts_with(regexp_replace(pdfPath, '^/+', ''), 'pdf/') or not regexp_matches(pdfPath, '(?i)[^/]\\.pdf$') then 'PDF_PATH_INVALID' end,
  case when coalesce(trim(revisionDate), '') <> '' and not {_ISO('revisionDate')} then 'REVISION_DATE_INVALID' end, case when coalesce(trim(c), '') <> '' and not {_ISO('c')} then 'CANDIDATE_REVISION_DATE_INVALID' end,
  case when coalesce(trim(c), '') <> '' and coalesce(trim(revisionDate), '') <> '' and trim(c) <> trim(revisionDate) then 'REVISION_DATE_CONFLICT' end, case when coalesce(trim(g), '') not in ('', '위험', '경고', '해당없음') then 'SIGNAL_WORD_INVALID' end], lambda x: x is not null)"""
_O12 = "o as (select productId, first(revisionDateCandidate order by override_no) as c, first(signalWordCandidate order by override_no) as g from msds_overrides where productId is not null group by 1)"
_SUMMARY = "(coalesce(trim(ppeSummary), '') <> '' or coalesce(trim(signalWord), '') <> '' or coalesce(len(hazardStatements), 0) > 0 or coalesce(len(ghsCodes), 0) > 0)"


def publication_warnings(s: DataFrame) -> Column:
    """Warning codes of an entry with its document's candidates c (date) and g (signal word), in their order."""
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    p = F.coalesce("pdfPath", F.lit(""))
    bad = p.rlike("^https?://") | ~F.regexp_replace(p, "^/+", "").startswith("pdf/") | ~p.rlike(r"(?i)[^/]\.pdf$")
    return F.array_compact(F.array(
        F.when(p == "", "PDF_PATH_MISSING").when(bad, "PDF_PATH_INVALID"), F.when((t("revisionDate") != "") & ~iso(F.col("revisionDate")), "REVISION_DATE_INVALID"), F.when((t("c") != "") & ~iso(F.col("c")), "CANDIDATE_REVISION_DATE_INVALID"),
        F.when((t("c") != "") & (t("revisionDate") != "") & (t("c") != t("revisionDate")), "REVISION_DATE_CONFLICT"), F.when(~t("g").isin(*SIGNALS), "SIGNAL_WORD_INVALID"),
    ))


def _with_document(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min(F.struct("override_no", F.col("revisionDateCandidate").alias("c"), F.col("signalWordCandidate").alias("g"))).alias("o")).select("__id", "o.c", "o.g")
    return table(spark, d, "msds_sample").join(o, F.col("id") == F.col("__id"), "left")


@query(f"with {_O12} select row_no, array_to_string({_WARN}, ',') as warnings from msds_sample left join o on productId = id")
def val2_publication_warnings(spark: SparkSession, d: str) -> DataFrame:
    s = _with_document(spark, d)
    return s.select("row_no", F.array_join(publication_warnings(s), ",").alias("warnings"))


@query(f"""with {_O12}, w as (select *, {_WARN} as ws from msds_sample left join o on productId = id) select row_no, id, productName, case when list_contains(ws, 'SIGNAL_WORD_INVALID') then null else g end as signal_candidate, case when len(list_intersect(ws, ['REVISION_DATE_CONFLICT', 'CANDIDATE_REVISION_DATE_INVALID'])) > 0 then null else c end as date_candidate,
  {_SUMMARY} as has_summary, case when not {_SUMMARY} then 'pdf_only' when len(ws) > 0 then 'automatic_with_warnings' else 'automatic' end as status from w""")
def mrg12_public_records(spark: SparkSession, d: str) -> DataFrame:
    """The published record of every entry: checked, its questionable fields left out, its state stated."""
    s = _with_document(spark, d)
    s = s.withColumn("ws", publication_warnings(s))
    t = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    some = t("ppeSummary") | t("signalWord") | n("hazardStatements") | n("ghsCodes")
    return s.select(
        "row_no", "id", "productName", F.when(~F.array_contains("ws", "SIGNAL_WORD_INVALID"), F.col("g")).alias("signal_candidate"),
        F.when(~F.arrays_overlap("ws", F.array(F.lit("REVISION_DATE_CONFLICT"), F.lit("CANDIDATE_REVISION_DATE_INVALID"))), F.col("c")).alias("date_candidate"),
        some.alias("has_summary"), F.when(~some, "pdf_only").when(F.size("ws") > 0, "automatic_with_warnings").otherwise("automatic").alias("status"),
    )


@query("""select inventory_no, 'msds-pdf-' || left(sha256, 16) as id, coalesce(nullif(trim(productNameCandidates[1]), ''), regexp_replace(fileName, '(?i)\\.pdf$', '')) as name, 'pdf/' || relativePath as pdfPath, len(casNoCandidates) as components from pdf_inventory where inventoryStatus = 'unmatched'""")
def mrg13_absorbed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files without an entry, as entries."""
    p = table(spark, d, "pdf_inventory").where("inventoryStatus = 'unmatched'")
    name = F.coalesce(F.nullif(F.trim(F.get("productNameCandidates", F.lit(0))), F.lit("")), F.regexp_replace("fileName", r"(?i)\.pdf$", ""))
    return p.select("inventory_no", F.concat(F.lit("msds-pdf-"), F.substring("sha256", 1, 16)).alias("id"), name.alias("name"), F.concat(F.lit("pdf/"), "relativePath").alias("pdfPath"), F.size("casNoCandidates").cast("bigint").alias("components"))


_SPQ = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{3000}}\\x{{a0}}]+', ' ', 'g'))"


@query(f"""select row_no, field, before, after from (select row_no, unnest(['productName', 'supplier', 'pdfPath']) as field, unnest([coalesce(productName, ''), coalesce(supplier, ''), coalesce(pdfPath, '')]) as before, unnest([{_SPQ('productName')}, {_SPQ('supplier')}, case when {_SPQ('pdfPath')} = '' then '' else {_SPQ('pdfPath')} end]) as after from msds_sample) where before <> after""")
def mrg14_change_log(spark: SparkSession, d: str) -> DataFrame:
    """What the final cleaning changes, field by field."""
    fields = ["productName", "supplier", "pdfPath"]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("before"), cl.spaces(F.col(f)).alias("after")) for f in fields])
    return table(spark, d, "msds_sample").select("row_no", F.explode(rows).alias("x")).select("row_no", "x.*").where("before <> after")


_CORE = lambda c: f"regexp_replace(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '[(（\\[][^)）\\]]*[)）\\]]?', '', 'g'), '[/;,].*$', '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""select i.row_no, i.item_no, case when coalesce(trim(i.chemicalName), '') = '' then 'replace' when {_CORE('i.chemicalName')} = {_CORE('r.chemicalName')} then 'keep' when {_CORE('i.chemicalName')} in (select {_CORE('chemicalName')} from substance_ref) then 'replace' else 'keep' end as action from msds_ingredient i join substance_ref r on r.casNo = trim(i.casNo)""")
def mrg15_name_repairs(spark: SparkSession, d: str) -> DataFrame:
    """A name is replaced only if it is missing or is that of another number."""
    r = table(spark, d, "substance_ref")
    ref = r.select(F.col("casNo").alias("c"), cl.name_core(F.col("chemicalName")).alias("k"))
    known = r.select(cl.name_core(F.col("chemicalName")).alias("k2")).distinct()
    j = table(spark, d, "msds_ingredient").join(ref, F.trim("casNo") == F.col("c")).withColumn("mine", cl.name_core(F.col("chemicalName"))).join(known, F.col("mine") == F.col("k2"), "left")
    return j.select("row_no", "item_no", F.when(F.coalesce(F.trim("chemicalName"), F.lit("")) == "", "replace").when(F.col("mine") == F.col("k"), "keep").when(F.col("k2").isNotNull(), "replace").otherwise("keep").alias("action"))


@query("""with o as (select productId, first(ghsCodes order by override_no) as codes from msds_overrides where productId is not null group by 1) select row_no, array_to_string(list_sort(list_filter(o.codes, lambda x: not list_contains(s.ghsCodes, x))), ',') as missing, array_to_string(list_sort(list_filter(s.ghsCodes, lambda x: not list_contains(o.codes, x))), ',') as extra from msds_sample s join o on o.productId = s.id where o.codes is not null and s.ghsCodes is not null""")
def mrg16_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Codes that the document has and the entry lacks, and the other way round."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min_by("ghsCodes", "override_no").alias("codes"))
    j = table(spark, d, "msds_sample").join(o, F.col("id") == F.col("__id")).where("codes is not null and ghsCodes is not null")
    less = lambda a, b: F.array_join(F.array_sort(F.filter(a, lambda x: ~F.array_contains(b, x))), ",")
    return j.select("row_no", less("codes", F.col("ghsCodes")).alias("missing"), less("ghsCodes", F.col("codes")).alias("extra"))


@query(f"select override_no, reviewStatus, case when coalesce(trim(signalWordCandidate), '') in ('', '위험', '경고', '해당없음') and (coalesce(trim(revisionDateCandidate), '') = '' or {_ISO('revisionDateCandidate')}) then 'passed' else 'failed' end as machine from msds_overrides")
def mrg17_machine_result(spark: SparkSession, d: str) -> DataFrame:
    """The machine's check beside the people's state, which it doesn't touch."""
    v = F.coalesce(F.trim("revisionDateCandidate"), F.lit(""))
    ok = F.coalesce(F.trim("signalWordCandidate"), F.lit("")).isin(*SIGNALS) & ((v == "") | iso(F.col("revisionDateCandidate")))
    return table(spark, d, "msds_overrides").select("override_no", "reviewStatus", F.when(ok, "passed").otherwise("failed").alias("machine"))


@query("""with o as (select productId, first(sourcePdfPath order by override_no) filter (sourcePdfPath <> '') as p from msds_overrides where productId is not null group by 1) select row_no, coalesce(p, pdfPath, '') as public_path from msds_sample left join o on productId = id""")
def mrg18_public_paths(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min(F.when(F.col("sourcePdfPath") != "", F.struct("override_no", "sourcePdfPath"))).getField("sourcePdfPath").alias("p"))
    return table(spark, d, "msds_sample").join(o, F.col("id") == F.col("__id"), "left").select("row_no", F.coalesce("p", "pdfPath", F.lit("")).alias("public_path"))


@query("select before, after, count(*) as n from (select distinct productId, matchTarget.productName as before, productNameCandidate as after from msds_overrides where matchTarget.productName <> '' and productNameCandidate <> '' and matchTarget.productName <> productNameCandidate) group by all")
def mrg19_repair_union(spark: SparkSession, d: str) -> DataFrame:
    """Repairs of names, each pair once, with the number of entries it applies to."""
    o = table(spark, d, "msds_overrides").select("productId", F.col("matchTarget.productName").alias("before"), F.col("productNameCandidate").alias("after")).where("before <> '' and after <> '' and before <> after").distinct()
    return o.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("select i.row_no, i.item_no, i.chemicalName as before, r.chemicalName as after from msds_ingredient i join substance_ref r on r.casNo = trim(i.casNo) where r.chemicalName is distinct from i.chemicalName")
def mrg20_translated_names(spark: SparkSession, d: str) -> DataFrame:
    """The log of names that the reference name of their number replaces."""
    r = table(spark, d, "substance_ref").select(F.col("casNo").alias("c"), F.col("chemicalName").alias("after"))
    j = table(spark, d, "msds_ingredient").join(r, F.trim("casNo") == F.col("c"))
    return j.where(~F.col("after").eqNullSafe(F.col("chemicalName"))).select("row_no", "item_no", F.col("chemicalName").alias("before"), "after")


@query("""with h as (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample), k as (select row_no, pos, s, substr(s, 1, 4) as code, regexp_replace(substr(s, 6), '\\s', '', 'g') as k, length(regexp_replace(s, '[^ ]', '', 'g')) as gaps from h where regexp_matches(s, '^H[0-9]{3} ')),
  c as (select code, k, first(substr(s, 6) order by row_no, pos) as body from k where gaps >= 4 group by all) select row_no, pos, case when gaps < 4 and body is not null then code || ' ' || body else s end as fixed from k left join c using (code, k)""")
def mrg21_spacing_pass(spark: SparkSession, d: str) -> DataFrame:
    """Coded statements with few blanks take the spacing of one with the same letters."""
    h = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("p", "s")).where(F.col("s").rlike("^H[0-9]{3} "))
    body = F.substring("s", 6, 1 << 20)
    k = h.select("row_no", (F.col("p") + 1).cast("bigint").alias("pos"), "s", F.substring("s", 1, 4).alias("code"), F.regexp_replace(body, r"\s", "").alias("k"), F.length(F.regexp_replace("s", "[^ ]", "")).alias("gaps"))
    c = k.where("gaps >= 4").groupBy("code", "k").agg(F.min(F.struct("row_no", "pos", body.alias("b"))).getField("b").alias("body"))
    return k.join(c, ["code", "k"], "left").select("row_no", "pos", F.when((F.col("gaps") < 4) & F.col("body").isNotNull(), F.concat("code", F.lit(" "), "body")).otherwise(F.col("s")).alias("fixed"))


@query("select row_no, lower(coalesce(fileName, '')) || '|' || lower(regexp_replace(coalesce(productName, ''), '\\s', '', 'g')) || '|' || lower(regexp_replace(coalesce(msdsNo, ''), '\\s', '', 'g')) as identity, coalesce(try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint), 1000000000) as score from msds_sample")
def mrg22_identities(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(c, F.lit(""))
    tight = lambda c: F.lower(F.regexp_replace(e(c), r"\s", ""))
    return table(spark, d, "msds_sample").select("row_no", F.concat_ws("|", F.lower(e("fileName")), tight("productName"), tight("msdsNo")).alias("identity"), F.coalesce(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint"), F.lit(1000000000)).alias("score"))


# checks

_NO = "[A-Z]{2}[0-9]{5}-[0-9]{10}"


def _finding(df: DataFrame, severity: str, code: str, subject: str) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))


@query(rf"""select 'error' as severity, 'PRODUCT_ID_MISSING' as code, cast(row_no as varchar) as subject from msds_sample where coalesce(trim(id), '') = ''
  union all select 'error', 'DUPLICATE_PRODUCT_ID', lower(id) from msds_sample where trim(id) <> '' group by lower(id) having count(*) > 1
  union all select 'error', 'DUPLICATE_PRODUCT_PDF', pdfPath from msds_sample where pdfPath <> '' group by pdfPath having count(distinct id) > 1
  union all select 'error', case when coalesce(pdfPath, '') = '' then 'PDF_PATH_MISSING' else 'PDF_PATH_INVALID' end, cast(row_no as varchar) from msds_sample where not (starts_with(regexp_replace(coalesce(pdfPath, ''), '^/+', ''), 'pdf/') and regexp_matches(pdfPath, '(?i)[^/]\.pdf$') and not regexp_matches(pdfPath, '(^|/)\.\.?(/|$)'))
  union all select 'error', 'PRODUCT_FILENAME_MISMATCH', cast(row_no as varchar) from msds_sample where fileName <> '' and pdfPath <> '' and fileName <> {_BASE('pdfPath')}
  union all select 'error', 'PRODUCT_OVERRIDE_MISSING', cast(row_no as varchar) from msds_sample s where id is not null and not exists (select 1 from msds_overrides o where o.productId = s.id)
  union all select 'error', 'REVISION_DATE_INVALID', cast(row_no as varchar) from msds_sample where coalesce(trim(revisionDate), '') <> '' and not {_ISO('revisionDate')}
  union all select 'error', 'SIGNAL_WORD_INVALID', cast(row_no as varchar) from msds_sample where coalesce(trim(signalWord), '') not in ('', '위험', '경고', '해당없음')
  union all select 'error', 'CANDIDATE_SIGNAL_WORD_INVALID', cast(override_no as varchar) from msds_overrides where coalesce(trim(signalWordCandidate), '') not in ('', '위험', '경고', '해당없음')
  union all select 'error', 'CANDIDATE_REVISION_DATE_INVALID', cast(override_no as varchar) from msds_overrides where coalesce(trim(revisionDateCandidate), '') <> '' and not {_ISO('revisionDateCandidate')}
  union all select 'warning', 'UNMATCHED_PUBLIC_OVERRIDE', cast(override_no as varchar) from msds_overrides o where not exists (select 1 from msds_sample s where s.id = o.productId)
  union all select 'error', 'UNLINKED_PDF_FILE', cast(inventory_no as varchar) from pdf_inventory p where not exists (select 1 from msds_sample s where s.fileName = p.fileName)
  union all select 'warning', 'MSDS_NUMBER_FORM', cast(row_no as varchar) from msds_sample where coalesce(msdsNo, '') <> '' and not regexp_full_match(msdsNo, '{_NO}')
  union all select 'warning', 'NO_HAZARD_TEXT', cast(row_no as varchar) from msds_sample where coalesce(len(hazardStatements), 0) = 0 and not coalesce(hazardNotClassified, false)""")
def val1_violations(spark: SparkSession, d: str) -> DataFrame:
    """The checks of a release over the tables: identity, files, dates, vocabulary, links in both directions."""
    s, o, p = table(spark, d, "msds_sample"), table(spark, d, "msds_overrides"), table(spark, d, "pdf_inventory")
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    t = lambda n: F.coalesce(F.trim(n), F.lit(""))
    sound = F.regexp_replace(c("pdfPath"), "^/+", "").startswith("pdf/") & c("pdfPath").rlike(r"(?i)[^/]\.pdf$") & ~c("pdfPath").rlike(r"(^|/)\.\.?(/|$)")
    rows = op.violations(s, "row_no", [
        ("error", "PRODUCT_ID_MISSING", t("id") == ""), ("error", "PDF_PATH_MISSING", c("pdfPath") == ""), ("error", "PDF_PATH_INVALID", (c("pdfPath") != "") & ~sound),
        ("error", "PRODUCT_FILENAME_MISMATCH", (c("fileName") != "") & (c("pdfPath") != "") & (c("fileName") != keys.base_name(c("pdfPath")))), ("error", "REVISION_DATE_INVALID", (t("revisionDate") != "") & ~iso(F.col("revisionDate"))),
        ("error", "SIGNAL_WORD_INVALID", ~t("signalWord").isin(*SIGNALS)), ("warning", "MSDS_NUMBER_FORM", (c("msdsNo") != "") & ~c("msdsNo").rlike(f"^{_NO}$")),
        ("warning", "NO_HAZARD_TEXT", (F.coalesce(F.size("hazardStatements"), F.lit(0)) <= 0) & ~F.coalesce("hazardNotClassified", F.lit(False))),
    ])
    docs = op.violations(o, "override_no", [("error", "CANDIDATE_SIGNAL_WORD_INVALID", ~t("signalWordCandidate").isin(*SIGNALS)), ("error", "CANDIDATE_REVISION_DATE_INVALID", (t("revisionDateCandidate") != "") & ~iso(F.col("revisionDateCandidate")))])
    parts = [
        rows, docs, _finding(s.where(t("id") != "").groupBy(F.lower("id").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "error", "DUPLICATE_PRODUCT_ID", "k"),
        _finding(s.where("pdfPath <> ''").groupBy("pdfPath").agg(F.countDistinct("id").alias("n")).where("n > 1"), "error", "DUPLICATE_PRODUCT_PDF", "pdfPath"),
        _finding(s.where("id is not null").join(o.select(F.col("productId").alias("id")), "id", "left_anti"), "error", "PRODUCT_OVERRIDE_MISSING", "row_no"),
        _finding(o.join(s.select(F.col("id").alias("productId")), "productId", "left_anti"), "warning", "UNMATCHED_PUBLIC_OVERRIDE", "override_no"), _finding(p.join(s.select("fileName"), "fileName", "left_anti"), "error", "UNLINKED_PDF_FILE", "inventory_no"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""with {_REG5}, live as (select distinct id from msds_sample) select 'REPLACEMENT_UNKNOWN' as code, id as subject from reg where replacedBy not in (select id from live where id is not null) union all select 'RETIRED_STILL_PUBLISHED', id from reg where id in (select id from live)
  union all select 'NUMBER_OUT_OF_SYNC', cast(row_no as varchar) from msds_sample s join (select productId, first(msdsNoCandidate order by override_no) as no from msds_overrides where reviewStatus = '승인' and productId is not null group by 1) e on e.productId = s.id where regexp_full_match(no, '{_NO}') and no is distinct from s.msdsNo""")
def val4_register_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the register agrees with what is published."""
    s, reg = table(spark, d, "msds_sample"), _register(spark, d)
    live = s.where("id is not null").select("id").distinct()
    e = table(spark, d, "msds_overrides").where("reviewStatus = '승인' and productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min_by("msdsNoCandidate", "override_no").alias("no"))
    off = s.join(e, F.col("id") == F.col("__id")).where(F.col("no").rlike(f"^{_NO}$") & ~F.col("no").eqNullSafe(F.col("msdsNo")))
    tag = lambda df, code, subject: df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))
    return tag(reg.join(live.select(F.col("id").alias("replacedBy")), "replacedBy", "left_anti"), "REPLACEMENT_UNKNOWN", "id").unionByName(tag(reg.join(live, "id", "left_semi"), "RETIRED_STILL_PUBLISHED", "id")).unionByName(tag(off, "NUMBER_OUT_OF_SYNC", "row_no"))


@query("""select (select count(*) from msds_sample) as deliveries, (select count(*) from msds_overrides) as documents, (select count(*) from pdf_inventory) as files, (select cast(sum(fileSize) as bigint) from pdf_inventory) as bytes, (select strftime(max(loaded_at), '%Y%m%d') from msds_sample) || '-' || (select count(*) from msds_sample) as version""")
def val5_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a release's manifest; a stored manifest is stale where one differs."""
    n = F.count(F.lit(1))
    s = table(spark, d, "msds_sample").agg(n.alias("deliveries"), F.date_format(F.max("loaded_at"), "yyyyMMdd").alias("day"))
    j = s.join(table(spark, d, "msds_overrides").agg(n.alias("documents"))).join(table(spark, d, "pdf_inventory").agg(n.alias("files"), F.sum("fileSize").alias("bytes")))
    return j.select("deliveries", "documents", "files", "bytes", F.concat_ws("-", "day", F.col("deliveries").cast("string")).alias("version"))


@query("""select override_no, unnest(list_filter([case when coalesce(matchTarget.relativePath, '') = '' then 'relativePath is required' end, case when coalesce(matchTarget.fileName, '') = '' then 'fileName is required' end, case when coalesce(reviewStatus, '') not in ('검토필요', '자동추출', '승인', '보류', '수정필요', '제외') then 'reviewStatus is unknown' end,
  case when len(list_filter(ghsCodes, lambda x: not regexp_full_match(x, 'GHS0[1-9]'))) > 0 then 'ghsCodes hold other codes' end, case when extractionMeta.pageCount < extractionMeta.extractedPageCount then 'more pages read than there are' end], lambda x: x is not null)) as problem from msds_overrides""")
def val6_review_file(spark: SparkSession, d: str) -> DataFrame:
    """Problems of a reviewed file: missing fields, unknown states, wrong codes."""
    c, e = F.col, lambda x: F.coalesce(F.col(x), F.lit(""))
    found = F.array_compact(F.array(
        F.when(e("matchTarget.relativePath") == "", F.lit("relativePath is required")), F.when(e("matchTarget.fileName") == "", F.lit("fileName is required")),
        F.when(~e("reviewStatus").isin("검토필요", "자동추출", "승인", "보류", "수정필요", "제외"), F.lit("reviewStatus is unknown")), F.when(F.exists("ghsCodes", lambda x: ~x.rlike("^GHS0[1-9]$")), F.lit("ghsCodes hold other codes")),
        F.when(c("extractionMeta.pageCount") < c("extractionMeta.extractedPageCount"), F.lit("more pages read than there are")),
    ))
    return table(spark, d, "msds_overrides").select("override_no", F.explode(found).alias("problem"))


_H = "regexp_extract_all(coalesce(array_to_string(hazardStatements, ' '), ''), 'H[0-9]{3}')"
_REQ = ", ".join(f"('{h}', '{g}')" for g, hs in text.REQUIRED.items() for h in hs.split())
_BIG = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, cast(i as int), 2)))"


@query(f"""with {_TOP}, m(h, g) as (values {_REQ}), x as (select row_no, signalWord, coalesce(ghsCodes, []) as have, list_distinct({_H}) as hs from msds_sample where not coalesce(hazardNotClassified, false)),
  f as (select row_no, have, unnest(hs) as h, list_contains(hs, 'H334') as resp, len(list_intersect(hs, ['{"', '".join(text.REQUIRED['GHS06'].split())}'])) > 0 as skull, len(list_intersect(hs, ['{"', '".join(text.REQUIRED['GHS05'].split())}'])) > 0 as corr from x),
  need as (select distinct row_no, have, m.g from f join m using (h) where not (m.g = 'GHS07' and (skull or (corr and f.h in ('H315', 'H319')) or (resp and f.h in ('H315', 'H317', 'H319'))))),
  odd as (select distinct p.row_no, p.code, t.common, regexp_replace(regexp_replace(lower(p.body), '[hp][0-9]{{3}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as mine from p join t using (code) where p.phrase <> t.common and length(regexp_replace(p.body, '[^A-Za-z]', '', 'g')) <= length(regexp_replace(p.body, '[^가-힣]', '', 'g')))
  select 'signal' as rule, row_no, array_to_string(list_sort(list_intersect(hs, ['{"', '".join(DANGER_ONLY)}'])), ',') as detail from x where signalWord = '경고' and len(list_intersect(hs, ['{"', '".join(DANGER_ONLY)}'])) > 0
  union all select 'pictogram', row_no, string_agg(g, ',' order by g) from need where not list_contains(have, g) group by row_no
  union all select 'phrase', row_no, string_agg(distinct code, ',' order by code) from odd where length(mine) > 1 and length(common) > 1 and len(list_intersect({_BIG('mine')}, {_BIG('common')})) < 0.2 * len(list_distinct(list_concat({_BIG('mine')}, {_BIG('common')}))) group by row_no""")
def val7_safety_rules(spark: SparkSession, d: str) -> DataFrame:
    """Findings of three rules on classified entries: a signal word too weak for a code, a pictogram that a code asks for
    and the entry lacks, a phrase unlike the usual one of its code. The fourth, on first aid, is rul12_vomit."""
    s = table(spark, d, "msds_sample").where(~F.coalesce("hazardNotClassified", F.lit(False)))
    h = F.array_distinct(F.regexp_extract_all(F.coalesce(F.array_join("hazardStatements", " "), F.lit("")), F.lit("H[0-9]{3}"), F.lit(0)))
    x = s.select("row_no", "signalWord", F.coalesce("ghsCodes", F.array().cast("array<string>")).alias("have"), h.alias("hs"))
    danger = F.array_join(F.array_sort(F.array_intersect("hs", F.array(*[F.lit(c) for c in DANGER_ONLY]))), ",")
    weak = x.where("signalWord = '경고'").select(F.lit("signal").alias("rule"), "row_no", danger.alias("detail")).where("detail <> ''")
    lacks = x.select(F.lit("pictogram").alias("rule"), "row_no", F.array_join(F.array_sort(F.array_except(text.required_pictograms(F.col("hs")), "have")), ",").alias("detail")).where("detail <> ''")
    p = phrases(table(spark, d, "msds_sample"))
    latin, hangul = F.length(F.regexp_replace("body", "[^A-Za-z]", "")), F.length(F.regexp_replace("body", "[^가-힣]", ""))
    j = p.join(usual_phrases(p).select("code", "common"), "code").where((F.col("phrase") != F.col("common")) & (latin <= hangul))
    mine = keys.word_key(F.regexp_replace(F.lower("body"), "[hp][0-9]{3}", ""))
    odd = j.withColumn("mine", mine).where((F.length("mine") > 1) & (F.length("common") > 1)).select("row_no", "code", "mine", "common").distinct().where(text.bigram_similarity(F.col("mine"), F.col("common")) < 0.2)
    out = odd.groupBy("row_no").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("detail")).select(F.lit("phrase").alias("rule"), "row_no", "detail")
    return weak.unionByName(lacks).unionByName(out)


@query("select s.row_no, p.inventory_no from msds_sample s join pdf_inventory p on p.fileName = s.fileName where exists (select 1 from pdf_inventory q where q.fileName = p.fileName and q.sha256 is distinct from p.sha256 and q.inventory_no < p.inventory_no)")
def val8_changed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Files listed again with another content than before, and the entries that rest on them."""
    p = table(spark, d, "pdf_inventory").where("fileName is not null").select("fileName", "inventory_no", "sha256")
    g = p.groupBy("fileName", "sha256").agg(F.min("inventory_no").alias("no"))
    first = g.groupBy("fileName").agg(F.min(F.struct("no", "sha256")).alias("f"))
    other = g.join(first, "fileName").where(~F.col("sha256").eqNullSafe(F.col("f.sha256"))).groupBy("fileName").agg(F.min("no").alias("second"), F.first("f").alias("f"))
    changed = p.join(other, "fileName").where(F.when(F.col("sha256").eqNullSafe(F.col("f.sha256")), F.col("inventory_no") > F.col("second")).otherwise(True))
    return table(spark, d, "msds_sample").select("row_no", "fileName").join(changed.select("fileName", "inventory_no"), "fileName").select("row_no", "inventory_no")


@query("""with dd as (select msds_no, string_agg(regexp_replace(text, '[\\s,.·ㆍ∙]', '', 'g'), '' order by doc_id) as t from documents where doc_kind = 'sheet' and msds_no is not null and text is not null group by 1), h as (select row_no, msdsNo, left(regexp_replace(unnest(hazardStatements), '[\\s,.·ㆍ∙]', '', 'g'), 40) as k from msds_sample where msdsNo is not null)
  select row_no, count(*) as statements, count(*) filter (not contains(t, k)) as missing from h join dd on msds_no = msdsNo where k <> '' group by row_no""")
def val9_text_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of an entry don't stand in the sheets of its number, by their first forty letters. Every pair of
    statement and sheet is looked at once and counts if any sheet holds it, so the sheets of a number aren't gathered."""
    strip = lambda c: F.regexp_replace(c, r"[\s,.·ㆍ∙]", "")
    dd = table(spark, d, "documents").where("doc_kind = 'sheet' and msds_no is not null and text is not null").select(F.col("msds_no").alias("msdsNo"), strip("text").alias("t"))
    h = table(spark, d, "msds_sample").where("msdsNo is not null").select("row_no", "msdsNo", F.posexplode("hazardStatements").alias("p", "s")).select("row_no", "msdsNo", "p", F.substring(strip("s"), 1, 40).alias("k")).where("k <> ''")
    j = h.join(dd, "msdsNo").groupBy("row_no", "p").agg(F.bool_or(F.contains("t", F.col("k"))).alias("found"))
    return j.groupBy("row_no").agg(F.count(F.lit(1)).alias("statements"), F.count_if(~F.col("found")).alias("missing"))


@query(f"""select row_no, count(*) as lines, count(*) filter (coalesce(trim(chemicalName), '') = '') as no_name, count(*) filter (regexp_matches(coalesce(casNo, ''), '#|REF|VALUE')) as error_cells, count(*) filter (coalesce(trim(casNo), '') <> '' and not coalesce({_CAS.format(c='trim(casNo)')}, false)) as no_number, max(item_no) as last_item, count(distinct item_no) as items from msds_ingredient group by row_no having count(*) filter (coalesce(trim(chemicalName), '') = '') > 0 or count(distinct item_no) <> max(item_no) or count(*) filter (coalesce(trim(casNo), '') <> '' and not coalesce({_CAS.format(c='trim(casNo)')}, false)) > 0""")
def val10_sheet_quality(spark: SparkSession, d: str) -> DataFrame:
    """Compositions with lines that lack a name or a sound number, or with gaps in their numbering."""
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    g = table(spark, d, "msds_ingredient").groupBy("row_no").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(t("chemicalName") == "").alias("no_name"), F.count_if(F.coalesce("casNo", F.lit("")).rlike("#|REF|VALUE")).alias("error_cells"),
        F.count_if((t("casNo") != "") & ~text.valid_cas(F.trim("casNo"))).alias("no_number"), F.max("item_no").alias("last_item"), F.countDistinct("item_no").alias("items"),
    )
    return g.where("no_name > 0 or items <> last_item or no_number > 0")


@query(f"with {_O12} select row_no, array_to_string(list_filter([case when coalesce(trim(revisionDate), '') = '' then 'no date' end, case when {_ISO('revisionDate')} and {_ISO('c')} and trim(c) > trim(revisionDate) then 'document is newer' end, case when coalesce(trim(signalWord), '') not in ('', '위험', '경고', '해당없음') then 'signal word' end, case when not regexp_matches(coalesce(pdfPath, ''), '(?i)\\.pdf$') then 'path' end], lambda x: x is not null), ', ') as problems from msds_sample left join o on productId = id")
def val11_safety_fields(spark: SparkSession, d: str) -> DataFrame:
    s = _with_document(spark, d)
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    newer = iso(F.col("revisionDate")) & iso(F.col("c")) & (F.trim("c") > F.trim("revisionDate"))
    found = F.array_compact(F.array(F.when(t("revisionDate") == "", "no date"), F.when(newer, "document is newer"), F.when(~t("signalWord").isin(*SIGNALS), "signal word"), F.when(~F.coalesce("pdfPath", F.lit("")).rlike(r"(?i)\.pdf$"), "path")))
    return s.select("row_no", F.array_join(found, ", ").alias("problems"))


@query("""select gate, n, n = 0 as passed from (select 'failed_extraction' as gate, count(*) as n from msds_overrides where contains(lower(extractStatus), 'failed') and reviewStatus <> '제외' union all select 'unreadable_file', count(*) from pdf_inventory where coalesce(textCharCount, 0) = 0 union all
  select 'changed_id', count(*) from (select pdfPath from msds_sample where pdfPath <> '' and id is not null group by 1 having count(distinct id) > 1))""")
def val12_build_gates(spark: SparkSession, d: str) -> DataFrame:
    """What must be zero before a build."""
    count = lambda df, g: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(g).alias("gate"), "n", (F.col("n") == 0).alias("passed"))
    ids = table(spark, d, "msds_sample").where("pdfPath <> '' and id is not null").groupBy("pdfPath").agg(F.countDistinct("id").alias("k")).where("k > 1")
    return count(table(spark, d, "msds_overrides").where(F.contains(F.lower("extractStatus"), F.lit("failed")) & (F.col("reviewStatus") != "제외")), "failed_extraction").unionByName(count(table(spark, d, "pdf_inventory").where("coalesce(textCharCount, 0) = 0"), "unreadable_file")).unionByName(count(ids, "changed_id"))


@query(f"""with {_O12}, v as (select productId, first(supplierCandidate order by override_no) as s, first(msdsNoCandidate order by override_no) as m from msds_overrides where productId is not null group by 1)
  select row_no, field, old, new, case when new = '' then 'keep' when old = '' then 'fill' when {_SEARCH('old')} = {_SEARCH('new')} then 'keep' else 'check' end as decision from (select row_no, unnest(['supplier', 'msdsNo']) as field, unnest([coalesce(supplier, ''), coalesce(msdsNo, '')]) as old, unnest([coalesce(s, ''), coalesce(m, '')]) as new from msds_sample join v on productId = id)""")
def val13_audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Values of the entry beside those of its document, with what to do."""
    v = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("__id")).agg(F.min(F.struct("override_no", "supplierCandidate", "msdsNoCandidate")).alias("o"))
    e = lambda c: F.coalesce(c, F.lit(""))
    rows = F.array(F.struct(F.lit("supplier").alias("field"), e("supplier").alias("old"), e("o.supplierCandidate").alias("new")), F.struct(F.lit("msdsNo").alias("field"), e("msdsNo").alias("old"), e("o.msdsNoCandidate").alias("new")))
    x = table(spark, d, "msds_sample").join(v, F.col("id") == F.col("__id")).select("row_no", F.explode(rows).alias("x")).select("row_no", "x.*")
    return x.withColumn("decision", F.when(F.col("new") == "", "keep").when(F.col("old") == "", "fill").when(keys.search_key(F.col("old")) == keys.search_key(F.col("new")), "keep").otherwise("check"))


@query(f"with {_O12} select row_no, unnest(list_filter([case when coalesce(c, '') <> '' and coalesce(revisionDate, '') = '' then 'date' end, case when coalesce(g, '') <> '' and coalesce(signalWord, '') = '' then 'signal' end], lambda x: x is not null)) as issue from msds_sample join o on productId = id")
def val15_visible_not_shown(spark: SparkSession, d: str) -> DataFrame:
    """What a document says and the entry doesn't show."""
    e = lambda c: F.coalesce(c, F.lit(""))
    s = _with_document(spark, d).where("__id is not null")
    found = F.array_compact(F.array(F.when((e("c") != "") & (e("revisionDate") == ""), "date"), F.when((e("g") != "") & (e("signalWord") == ""), "signal")))
    return s.select("row_no", F.explode(found).alias("issue"))


@query("select row_no, count(*) filter (v = 'marked') as marked, count(*) filter (v = 'other') as other from (select row_no, case when regexp_matches(trim(m), '^[○Oo●ㅇ]') then 'marked' when coalesce(trim(m), '') <> '' then 'other' end as v from (select row_no, unnest([managementTarget, workplaceMonitoringTarget, specialHealthCheckTarget]) as m from msds_ingredient)) group by row_no")
def val16_flag_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Flags of a composition that are circles, and those that are words."""
    m = table(spark, d, "msds_ingredient").select("row_no", F.explode(F.array("managementTarget", "workplaceMonitoringTarget", "specialHealthCheckTarget")).alias("m"))
    state = op.flag_state(F.col("m"))
    return m.groupBy("row_no").agg(F.count_if(state == "marked").alias("marked"), F.count_if(state == "cleared").alias("other"))


@query("""select count(*) as files, cast(sum(fileSize) as bigint) as bytes, sha256(string_agg(lower(relativePath) || '|' || coalesce(sha256, '') || chr(10), '' order by lower(relativePath), inventory_no)) as fingerprint from pdf_inventory""")
def val17_listing_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest over the listing in order. The lines of the library's listing, not its files, are joined: some 150 bytes a
    file, so it is a digest for libraries of some million files; agg17_fingerprint has no such bound."""
    p = table(spark, d, "pdf_inventory")
    line = F.struct(F.lower("relativePath").alias("p"), "inventory_no", F.concat(F.lower("relativePath"), F.lit("|"), F.coalesce("sha256", F.lit("")), F.lit("\n")).alias("l"))
    return p.agg(F.count(F.lit(1)).alias("files"), F.sum("fileSize").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.l), ""), 256).alias("fingerprint"))


@query("select 'msds_sample' as name, count(*) > 0 as ready from msds_sample union all select 'msds_overrides', count(*) > 0 from msds_overrides union all select 'pdf_inventory', count(*) > 0 from pdf_inventory union all select 'msds_ingredient', count(*) > 0 from msds_ingredient")
def val14_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Which tables there are and hold rows."""
    names = ("msds_sample", "msds_overrides", "pdf_inventory", "msds_ingredient")
    return reduce(DataFrame.unionByName, [table(spark, d, n).agg((F.count(F.lit(1)) > 0).alias("ready")).select(F.lit(n).alias("name"), "ready") for n in names])

