"""Queries of joins, groups, orders and set operations over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vialworks.functions import keys, text
from vialworks.functions.rules import holds
from vialworks.operators import catalogue as op
from vialworks.operators.ordered import previous
from vialworks.plans.catalogue import _B, _BASE, _CAS, _MATCH, _SEARCH, FLAGS, _sql_key, query
from vialworks.sources.tables import table

_CASNO = "regexp_replace(trim(casNo), '(?i)^CAS\\s*(No\\.?|번호)?\\s*[:.]?\\s*', '')"
_STATE = lambda f: f"case when coalesce(trim({f}), '') = '' then 'unstated' when regexp_matches(trim({f}), '^[○Oo●ㅇ]') then 'marked' else 'cleared' end"
_FLAG_SQL = ", ".join(f"count(*) filter ({_STATE(f)} = '{s}') as {f}_{s}" for f in FLAGS for s in ("marked", "cleared", "unstated"))
_SUBSTANCES = f"""ok as (select *, nullif(trim(chemicalName), '') as nm from (select *, {_CASNO} as cas_no from msds_ingredient) where coalesce({_CAS.format(c='cas_no')}, false)),
  t as (select cas_no, count(*) as n_rows, count(distinct productId) as n_products, {_FLAG_SQL} from ok group by cas_no),
  n as (select cas_no, nm, count(*) as c, regexp_matches(nm, ';|KE-[0-9]|[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') or length(nm) > 40 as clumsy from ok where nm is not null group by cas_no, nm),
  m as (select cas_no, first(nm order by clumsy, c desc, nm) as main_name, count(*) as n_names, string_agg(nm, ' / ' order by clumsy, c desc, nm) as spellings from n group by cas_no)"""


def _substances(spark: SparkSession, d: str) -> DataFrame:
    return op.substances(table(spark, d, "msds_ingredient"), "productId", "casNo", "chemicalName", {f: F.col(f) for f in FLAGS})


@query(f"with {_SUBSTANCES} select t.*, main_name, coalesce(n_names, 0) as n_names, spellings from t left join m using (cas_no)")
def agg1_substances(spark: SparkSession, d: str) -> DataFrame:
    return _substances(spark, d)


@query(f"select row_no, item_no, casNo from msds_ingredient where not coalesce({_CAS.format(c=_CASNO)}, false)")
def agg1_orphans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").where(op.registry_number(F.col("casNo")).isNull()).select("row_no", "item_no", "casNo")


@query(f"""with {_SUBSTANCES} select cas_no from t left join m using (cas_no) where contains({_sql_key("concat_ws(' ', cas_no, spellings)", r'()\[\]{}_\-/\\')}, 'neo') and managementTarget_cleared > 0""")
def flt4_substance_facets(spark: SparkSession, d: str) -> DataFrame:
    """Substances that answer a word and have a stated management flag."""
    s = _substances(spark, d)
    return s.where(F.contains(keys.page_key(F.concat_ws(" ", "cas_no", "spellings")), F.lit("neo")) & (F.col("managementTarget_cleared") > 0)).select("cas_no")


@query(f"with {_SUBSTANCES} select cas_no, case when workplaceMonitoringTarget_marked > 0 then '해당' when workplaceMonitoringTarget_cleared > 0 then '해당없음으로 적힘' else '표기 없음' end as flag_text from t")
def scl39_flag_text(spark: SparkSession, d: str) -> DataFrame:
    s = _substances(spark, d)
    return s.select("cas_no", F.when(F.col("workplaceMonitoringTarget_marked") > 0, "해당").when(F.col("workplaceMonitoringTarget_cleared") > 0, "해당없음으로 적힘").otherwise("표기 없음").alias("flag_text"))


@query(f"with {_SUBSTANCES} select cas_no, nm as spelling, row_number() over (partition by cas_no order by clumsy, c desc, nm) as place from n")
def win4_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a substance with its place: whole names first, then frequent ones."""
    ok = table(spark, d, "msds_ingredient").select(op.registry_number(F.col("casNo")).alias("cas_no"), keys.first_filled(F.col("chemicalName")).alias("spelling")).where("cas_no is not null and spelling is not null")
    n = ok.groupBy("cas_no", "spelling").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("cas_no").orderBy(op.clumsy_name(F.col("spelling")), F.desc("c"), "spelling")  # one row a spelling
    return n.select("cas_no", "spelling", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"""with {_SUBSTANCES}, u as (select cas_no, productId, first(content order by row_no, item_no) as content from ok group by cas_no, productId)
  select cas_no, main_name, spellings, productId, content, {", ".join(f"case when {f}_marked > 0 then '○' else '' end as {f}" for f in FLAGS)} from u join t using (cas_no) left join m using (cas_no)""")
def snk5_substance_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for every substance and product, as it is exported."""
    s = _substances(spark, d).select("cas_no", "main_name", "spellings", *[F.when(F.col(f"{f}_marked") > 0, "○").otherwise("").alias(f) for f in FLAGS])
    i = table(spark, d, "msds_ingredient").withColumn("cas_no", op.registry_number(F.col("casNo"))).where("cas_no is not null")
    uses = i.groupBy("cas_no", "productId").agg(F.min_by("content", F.struct("row_no", "item_no")).alias("content"))
    return uses.join(s, "cas_no").select("cas_no", "main_name", "spellings", "productId", "content", *FLAGS)


@query("""with o as (select productId, first(ghsCodes order by override_no) as codes from msds_overrides where productId is not null group by productId)
  select row_no, signalWord, array_to_string(case when len(s.ghsCodes) > 0 then s.ghsCodes else coalesce(o.codes, s.ghsCodes) end, ',') as codes, case when len(s.ghsCodes) > 0 then 'entry' when len(o.codes) > 0 then 'document' else 'none' end as codes_from
  from msds_sample s left join o on o.productId = s.id""")
def mrg1_fill_if_empty(spark: SparkSession, d: str) -> DataFrame:
    """Empty lists of an entry filled from its document; its signal word is never filled."""
    o = table(spark, d, "msds_overrides").where("productId is not null").groupBy("productId").agg(F.min(F.struct("override_no", "ghsCodes")).alias("o"))
    s = table(spark, d, "msds_sample").join(o, F.col("id") == F.col("productId"), "left")
    own, theirs = F.size("ghsCodes") > 0, F.size("o.ghsCodes") > 0
    return s.select("row_no", "signalWord", F.array_join(F.when(own, F.col("ghsCodes")).otherwise(F.coalesce("o.ghsCodes", "ghsCodes")), ",").alias("codes"), F.when(own, "entry").when(theirs, "document").otherwise("none").alias("codes_from"))


@query(f"""select row_no, item_no, code from (select row_no, item_no, case when regexp_full_match(c, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') then case when not coalesce({_CAS.format(c='c')}, false) then 'error:CAS_NUMBER_INVALID' end
  when regexp_matches(c, '[0-9]+-[0-9]+-[0-9]+') and len(list_filter(string_split_regex(c, '[,;/]'), lambda x: not coalesce({_CAS.format(c='trim(x)')}, false))) > 0 then 'warning:CAS_FIELD_NOT_STANDARD' end as code
  from (select row_no, item_no, trim(casNo) as c from msds_ingredient)) where code is not null""")
def val3_cas_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a wrong check digit, and fields with several or other numbers; plain words are no finding."""
    c = F.trim("casNo")
    parts = F.transform(F.split(c, "[,;/]"), lambda x: F.trim(x))
    code = F.when(c.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$"), F.when(~text.valid_cas(c), "error:CAS_NUMBER_INVALID")).when(
        c.rlike("[0-9]+-[0-9]+-[0-9]+") & F.exists(parts, lambda x: ~text.valid_cas(x)), "warning:CAS_FIELD_NOT_STANDARD"
    )
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", code.alias("code")).where("code is not null")


@query("""with k as (select distinct k from (select lower(fileName) as k from msds_sample union all select lower(list_extract(string_split(replace(pdfPath, '\\', '/'), '/'), -1)) from msds_sample union all select lower(matchTarget.fileName) from msds_overrides where productId in (select id from msds_sample)) where k <> ''),
  d as (select inventory_no, unnest(list_distinct([lower(fileName), lower(list_extract(string_split(replace(pdfPath, '\\', '/'), '/'), -1)), 'hash:' || lower(sha256)])) as k from pdf_inventory),
  free as (select inventory_no, k from d where inventory_no not in (select inventory_no from d join k using (k)) and k <> ''), f as (select k, min(inventory_no) as first from free group by k)
  select inventory_no from free join f using (k) group by inventory_no having min(first) = inventory_no""")
def jon4_document_only(spark: SparkSession, d: str) -> DataFrame:
    """Files that neither an entry nor the document of an entry names; of files that share a name or content the first."""
    s, o, p = table(spark, d, "msds_sample"), table(spark, d, "msds_overrides"), table(spark, d, "pdf_inventory")
    linked = o.join(s.select(F.col("id").alias("productId")).distinct(), "productId", "left_semi")
    known = s.select(F.lower("fileName").alias("k")).unionByName(s.select(F.lower(keys.base_name(F.col("pdfPath"))).alias("k"))).unionByName(linked.select(F.lower("matchTarget.fileName").alias("k"))).where("k <> ''").distinct()
    doc = p.select("inventory_no", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("fileName"), F.lower(keys.base_name(F.col("pdfPath"))), F.concat(F.lit("hash:"), F.lower("sha256")))))).alias("k")).where("k <> ''")
    free = doc.join(doc.join(known, "k").select("inventory_no").distinct(), "inventory_no", "left_anti")
    first = free.groupBy("k").agg(F.min("inventory_no").alias("first"))
    return free.join(first, "k").groupBy("inventory_no").agg(F.min("first").alias("first")).where("first = inventory_no").select("inventory_no")


_CARRY = ", ".join(f"case when coalesce(trim(i.{f}), '') <> '' then i.{f} else coalesce(d.{f}, i.{f}) end as {f}" for f in FLAGS)
_DONOR = ", ".join(f"first({f} order by row_no, item_no) filter (trim({f}) <> '') as {f}" for f in FLAGS)


@query(f"with d as (select productId, trim(casNo) as c, {_DONOR} from msds_ingredient where trim(casNo) <> '' group by all) select i.row_no, i.item_no, {_CARRY} from msds_ingredient i left join d on d.productId = i.productId and d.c = trim(i.casNo)")
def jon11_carried_flags(spark: SparkSession, d: str) -> DataFrame:
    """Ingredient lines whose blank legal flags are taken from the first line of the same product and number that states them."""
    i = table(spark, d, "msds_ingredient")
    filled = lambda f: F.when(F.trim(f) != "", F.struct("row_no", "item_no", F.col(f).alias("v")))
    donors = i.where("trim(casNo) <> ''").groupBy(F.col("productId").alias("__p"), F.trim("casNo").alias("__c")).agg(*[F.min(filled(f)).getField("v").alias(f"__{f}") for f in FLAGS])
    j = i.join(donors, (F.col("productId") == F.col("__p")) & (F.trim("casNo") == F.col("__c")), "left")
    return j.select("row_no", "item_no", *[F.when(F.coalesce(F.trim(f), F.lit("")) != "", F.col(f)).otherwise(F.coalesce(f"__{f}", f)).alias(f) for f in FLAGS])


@query(f"""with r as (select {_sql_key('chemicalName', r',，/\\_\-()（）')} as k, first(physicalState order by casNo) as state, bool_or(monitored) as monitored from substance_ref group by 1)
  select i.row_no, i.item_no, case when coalesce(trim(workplaceMonitoringTarget), '') <> '' then workplaceMonitoringTarget when r.monitored then '○' else '해당없음' end as flag
  from msds_ingredient i join r on r.k = {_sql_key('i.chemicalName', r',，/\\_\-()（）')} where r.k <> ''""")
def jon10_flags_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Blank monitoring flags filled by the substance's name; what the source leaves blank becomes 'not applicable'."""
    r = table(spark, d, "substance_ref").groupBy(keys.name_key(F.col("chemicalName")).alias("k")).agg(F.bool_or("monitored").alias("m")).where("k <> ''")
    i = table(spark, d, "msds_ingredient").withColumn("k", keys.name_key(F.col("chemicalName")))
    flag = F.when(F.coalesce(F.trim("workplaceMonitoringTarget"), F.lit("")) != "", F.col("workplaceMonitoringTarget")).when(F.col("m"), "○").otherwise("해당없음")
    return i.join(r, "k").select("row_no", "item_no", flag.alias("flag"))


_J2R = [("0", "lower(matchTarget.fileName)"), ("1", "matchTarget.msdsNo"), ("2", "lower(sourcePdfPath)"), ("3", "regexp_replace(lower(sourcePdfPath), '^/?pdf/', '')")]
_J2L = ["lower(fileName)", "msdsNo", "lower(pdfPath)", "regexp_replace(lower(pdfPath), '^/?pdf/', '')", f"lower({_BASE('pdfPath')})"]


@query(f"""with r as (select k, min(override_no) as override_no from ({" union all ".join(f"select override_no, {k} as k from msds_overrides" for _, k in _J2R)}) where k <> '' group by k),
  l as ({" union all ".join(f"select row_no, {i} as p, {k} as k from msds_sample" for i, k in enumerate(_J2L))})
  select row_no, override_no from (select row_no, override_no, row_number() over (partition by row_no order by p, override_no) as n from l join r using (k) where k <> '') where n = 1""")
def jon2_multi_key(spark: SparkSession, d: str) -> DataFrame:
    """The document of an entry by any of five keys of the entry in any of four keys of the document."""
    s, o, c = table(spark, d, "msds_sample"), table(spark, d, "msds_overrides"), F.col
    bare = lambda x: F.regexp_replace(F.lower(x), "^/?pdf/", "")
    right = [F.lower("matchTarget.fileName"), c("matchTarget.msdsNo"), F.lower("sourcePdfPath"), bare("sourcePdfPath")]
    left = [F.lower("fileName"), c("msdsNo"), F.lower("pdfPath"), bare("pdfPath"), F.lower(keys.base_name(c("pdfPath")))]
    first = o.select("override_no", F.explode(F.array_compact(F.array(*right))).alias("k")).where("k <> ''").groupBy("k").agg(F.min("override_no").alias("override_no"))
    asked = s.select("row_no", F.posexplode(F.array(*left)).alias("p", "k")).where("k <> ''")
    return asked.join(first, "k").groupBy("row_no").agg(F.min(F.struct("p", "override_no")).alias("m")).select("row_no", "m.override_no")


@query(f"""with l as (select row_no, unnest(list_distinct([{_SEARCH('fileName')}, {_SEARCH(_BASE('pdfPath'))}])) as k from msds_sample), r as (select inventory_no, unnest(list_distinct([{_SEARCH('fileName')}, {_SEARCH(_BASE('pdfPath'))}])) as k from pdf_inventory)
  select row_no, min(inventory_no) as inventory_no, count(distinct inventory_no) as files from l join r using (k) where k <> '' group by row_no""")
def jon3_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Files that share any key with an entry: the first, and how many."""
    k = [keys.search_key(F.col("fileName")), keys.search_key(keys.base_name(F.col("pdfPath")))]
    pairs = op.key_overlap(table(spark, d, "msds_sample"), "row_no", k, table(spark, d, "pdf_inventory"), "inventory_no", k)
    return pairs.groupBy("row_no").agg(F.min("inventory_no").alias("inventory_no"), F.count(F.lit(1)).alias("files"))


@query(f"select row_no from msds_sample s where fileName in (select fileName from pdf_inventory where fileName <> '') or ({_MATCH('fileName')} <> '' and {_MATCH('fileName')} in (select {_MATCH('fileName')} from pdf_inventory where fileName is not null))")
def jon6_with_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries that have a file, by its name or its key."""
    k = keys.match_key(F.col("fileName")).alias("k")
    files = table(spark, d, "pdf_inventory").select(k).where("k <> ''").distinct()
    return table(spark, d, "msds_sample").select("row_no", k).where("k <> ''").join(files, "k", "left_semi").select("row_no")


@query("""select kind, count(*) as n, min(key) as example from (select 'unregistered_file' as kind, fileName as key from pdf_inventory p where not exists (select 1 from msds_sample s where s.fileName = p.fileName)
  union all select 'missing_file', fileName from msds_sample s where fileName is not null and not exists (select 1 from pdf_inventory p where p.fileName = s.fileName)
  union all select 'document_without_file', matchTarget.fileName from msds_overrides o where not exists (select 1 from pdf_inventory p where p.fileName = o.matchTarget.fileName)
  union all select 'document_without_entry', matchTarget.fileName from msds_overrides o where not exists (select 1 from msds_sample s where s.id = o.productId)) group by kind""")
def jon7_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    """What has no counterpart: files without an entry, entries and documents without a file, documents without an entry."""
    s, o, p = table(spark, d, "msds_sample"), table(spark, d, "msds_overrides"), table(spark, d, "pdf_inventory")
    docs = o.select(F.col("matchTarget.fileName").alias("fileName"), "productId")
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("fileName").alias("key"))
    parts = tag(p.join(s.select("fileName"), "fileName", "left_anti"), "unregistered_file").unionByName(tag(s.where("fileName is not null").join(p.select("fileName"), "fileName", "left_anti"), "missing_file"))
    parts = parts.unionByName(tag(docs.join(p.select("fileName"), "fileName", "left_anti"), "document_without_file")).unionByName(tag(docs.join(s.select(F.col("id").alias("productId")), "productId", "left_anti"), "document_without_entry"))
    return parts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))


_REG = "reg as (select old as id, first(id order by row_no) as replacedBy from (select row_no, id, unnest(formerIds) as old from msds_sample) group by old)"
_LIVE = "live as (select id, first(productName order by load_no desc, row_no desc) as productName, first(supplier order by load_no desc, row_no desc) as supplier from msds_sample where id is not null group by id)"


@query(f"with {_REG}, {_LIVE} select reg.id, l.productName as live_name, reg.replacedBy, r.productName as replacement_name from reg left join live l on l.id = reg.id left join live r on r.id = reg.replacedBy")
def jon8_register(spark: SparkSession, d: str) -> DataFrame:
    """Retired ids with the entry that still has them, if any, and the entry that replaced them."""
    live = _live(spark, d)
    return _register(spark, d).join(live.select("id", F.col("productName").alias("live_name")), "id", "left").join(live.select(F.col("id").alias("replacedBy"), F.col("productName").alias("replacement_name")), "replacedBy", "left").select("id", "live_name", "replacedBy", "replacement_name")


def _register(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", F.col("id").alias("new"), F.explode("formerIds").alias("id")).groupBy("id").agg(F.min_by("new", "row_no").alias("replacedBy"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every entry."""
    return table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max(F.struct("load_no", "row_no", "productName", "supplier")).alias("m")).select("id", "m.productName", "m.supplier")


@query(f"""with {_REG}, {_LIVE}, asked as (select distinct id as asked from reg union select distinct productId from msds_overrides where productId is not null union select 'msds-unknown-' || (row_no % 7) from msds_sample)
  select asked, coalesce(l.id, reg.replacedBy) as id, case when l.id is not null then 'id' when reg.id is not null then 'successor' else 'unknown' end as found_by from asked left join live l on l.id = asked left join reg on reg.id = asked""")
def jon12_requested_ids(spark: SparkSession, d: str) -> DataFrame:
    """Asked ids resolved: to themselves, to their successor, or not at all."""
    live, reg = _live(spark, d).select("id"), _register(spark, d)
    asked = reg.select(F.col("id").alias("asked")).unionByName(table(spark, d, "msds_overrides").select(F.col("productId").alias("asked"))).unionByName(table(spark, d, "msds_sample").select(F.concat(F.lit("msds-unknown-"), (F.col("row_no") % 7).cast("string")).alias("asked"))).where("asked is not null").distinct()
    j = asked.join(live.withColumnRenamed("id", "l"), F.col("asked") == F.col("l"), "left").join(reg.select(F.col("id").alias("r"), "replacedBy"), F.col("asked") == F.col("r"), "left")
    return j.select("asked", F.coalesce("l", "replacedBy").alias("id"), F.when(F.col("l").isNotNull(), "id").when(F.col("r").isNotNull(), "successor").otherwise("unknown").alias("found_by"))


@query(f"""with {_LIVE}, n as (select {_SEARCH('productName')} as k, min(id) as id, count(*) as c from live where productName is not null group by 1), a as (select distinct override_no, {_SEARCH('productNameCandidate')} as k from msds_overrides where productNameCandidate is not null)
  select override_no, case when c = 1 then n.id end as id, case when c = 1 then 'name' when c > 1 then 'ambiguous' else 'unknown' end as found_by from a left join n using (k) where k <> ''""")
def jon12_requested_names(spark: SparkSession, d: str) -> DataFrame:
    """Asked names resolved where exactly one entry has the name."""
    k = lambda c: keys.search_key(F.col(c)).alias("k")
    n = _live(spark, d).where("productName is not null").groupBy(k("productName")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    a = table(spark, d, "msds_overrides").where("productNameCandidate is not null").select("override_no", k("productNameCandidate")).where("k <> ''")
    return a.join(n, "k", "left").select("override_no", F.when(F.col("c") == 1, F.col("id")).alias("id"), F.when(F.col("c") == 1, "name").when(F.col("c") > 1, "ambiguous").otherwise("unknown").alias("found_by"))


@query(f"""with q as (select inventory_no, unnest(list_distinct([lower(relativePath), lower(fileName), lower({_BASE('pdfPath')})])) as k from pdf_inventory), o as (select distinct unnest(list_distinct([lower(matchTarget.relativePath), lower(matchTarget.fileName), lower({_BASE('sourcePdfPath')})])) as k from msds_overrides)
  select distinct inventory_no from q join o using (k) where k <> ''""")
def jon13_files_with_document(spark: SparkSession, d: str) -> DataFrame:
    """Files that a document names by path, name or base name."""
    spread = lambda df, cs, i: df.select(*i, F.explode(F.array_compact(F.array(*cs))).alias("k")).where("k <> ''")
    o = spread(table(spark, d, "msds_overrides"), [F.lower("matchTarget.relativePath"), F.lower("matchTarget.fileName"), F.lower(keys.base_name(F.col("sourcePdfPath")))], []).distinct()
    q = spread(table(spark, d, "pdf_inventory"), [F.lower("relativePath"), F.lower("fileName"), F.lower(keys.base_name(F.col("pdfPath")))], ["inventory_no"])
    return q.join(o, "k", "left_semi").select("inventory_no").distinct()


@query("""with m as (select override_no, unnest(['id', 'name', 'number']) as kind, unnest([productId, matchTarget.productName, matchTarget.msdsNo]) as k, matchTarget.fileName as file from msds_overrides),
  s as (select row_no, unnest(['id', 'name', 'number']) as kind, unnest([id, productName, msdsNo]) as k from msds_sample) select row_no, min(file) as file, count(distinct file) as files from s join m using (kind, k) where k <> '' and file <> '' group by row_no""")
def jon14_manual_map(spark: SparkSession, d: str) -> DataFrame:
    """Files mapped to an entry by its id, name or number.

    A name or number like '-' stands in many entries and many files, so rows aren't joined with files: files are counted by
    key, and what the keys of a row have in common is counted once for every combination of keys.
    """
    c = F.col

    def spread(df: DataFrame, cols: list, more: str) -> DataFrame:
        return df.select(more, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("k")) for k, c in zip(("id", "name", "number"), cols, strict=True)])).alias("x")).select(more, "x.*").where("k <> ''")

    m = spread(table(spark, d, "msds_overrides").withColumn("file", c("matchTarget.fileName")), [c("productId"), c("matchTarget.productName"), c("matchTarget.msdsNo")], "file").where("file <> ''").distinct()
    s = spread(table(spark, d, "msds_sample"), [c("id"), c("productName"), c("msdsNo")], "row_no")
    by_key = m.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    rows = s.join(by_key, ["kind", "k"]).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "k"))).alias("x"), F.sum("n").alias("n"), F.min("file").alias("file"))
    rows = rows.withColumn("x", F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), x["k"].alias("k"))))
    # Of two or three sets, those in the first (the smallest) and the others; three sets count again what two counted twice.
    few = lambda *at: F.when(F.size("x") > max(at), F.array(*[F.get("x", F.lit(i)) for i in at]))
    sets = rows.where(F.size("x") > 1).select("row_no", F.explode(F.array_compact(F.array(few(0, 1), few(0, 2), few(1, 2), few(0, 1, 2)))).alias("g"))
    asked = sets.select("g").distinct().select("g", F.get("g", F.lit(0)).alias("f"))
    inside = asked.join(m, (c("f.kind") == c("kind")) & (c("f.k") == c("k"))).select("g", "file", F.explode(F.slice("g", 2, 2)).alias("o")).join(m.select("file", F.struct("kind", "k").alias("o")), ["o", "file"], "left_semi")
    common = inside.groupBy("g", "file").agg(F.count(F.lit(1)).alias("held")).where(c("held") == F.size("g") - 1).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    twice = sets.join(common, "g").groupBy("row_no").agg(F.sum(F.when(F.size("g") == 2, c("n")).otherwise(-c("n"))).alias("less"))
    return rows.join(twice, "row_no", "left").select("row_no", "file", (c("n") - F.coalesce("less", F.lit(0))).alias("files"))


@query("""with b as (select load_no, min(row_no) as a, max(row_no) as z from msds_sample group by load_no) select load_no, count(*) as lines, count(distinct productId) as products from msds_ingredient i join b on i.row_no between a and z group by load_no""")
def jon15_block_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ingredient lines by the block of rows they fall into; blocks are few, one a load, and broadcast."""
    blocks = table(spark, d, "msds_sample").groupBy("load_no").agg(F.min("row_no").alias("a"), F.max("row_no").alias("z"))
    return table(spark, d, "msds_ingredient").join(F.broadcast(blocks), F.col("row_no").between(F.col("a"), F.col("z"))).groupBy("load_no").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("productId").alias("products"))


@query(f"""with k as (select row_no, unnest([0, 1, 2]) as p, unnest([{_SEARCH('pdfPath')}, {_SEARCH(_BASE('pdfPath'))}, {_SEARCH('fileName')}]) as k from msds_sample), f as (select k, min(inventory_no) as inventory_no from (select inventory_no, unnest([{_SEARCH('pdfPath')}, {_SEARCH(_BASE('pdfPath'))}, {_SEARCH('fileName')}]) as k from pdf_inventory) where k <> '' group by k)
  select row_no, arg_min(inventory_no, p) as inventory_no from k join f using (k) group by row_no""")
def jon16_record_file(spark: SparkSession, d: str) -> DataFrame:
    """The file of an entry by its path, base name or name, in this order."""
    ks = [keys.search_key(F.col("pdfPath")), keys.search_key(keys.base_name(F.col("pdfPath"))), keys.search_key(F.col("fileName"))]
    f = table(spark, d, "pdf_inventory").select("inventory_no", F.explode(F.array_compact(F.array(*ks))).alias("k")).where("k <> ''").groupBy("k").agg(F.min("inventory_no").alias("inventory_no"))
    k = table(spark, d, "msds_sample").select("row_no", F.posexplode(F.array(*ks)).alias("p", "k")).where("k <> ''")
    return k.join(f, "k").groupBy("row_no").agg(F.min_by("inventory_no", "p").alias("inventory_no"))


@query(f"""with {_LIVE} select override_no, coalesce(nullif(trim(l.productName), ''), productNameCandidate) as name, coalesce(nullif(trim(l.supplier), ''), supplierCandidate) as supplier from msds_overrides o join live l on l.id = o.productId""")
def jon17_refreshed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose candidates are overwritten by the entry's values that aren't blank."""
    j = table(spark, d, "msds_overrides").join(_live(spark, d), F.col("id") == F.col("productId"))
    return j.select("override_no", F.coalesce(F.nullif(F.trim("productName"), F.lit("")), "productNameCandidate").alias("name"), F.coalesce(F.nullif(F.trim("supplier"), F.lit("")), "supplierCandidate").alias("supplier"))


@query("""with o as (select matchTarget.fileName as f, first(reviewStatus order by override_no) as decision from msds_overrides group by 1), s as (select distinct fileName as f from msds_sample)
  select inventory_no, coalesce(decision, '') as decision, s.f is not null as registered, inventoryStatus from pdf_inventory p left join o on o.f = p.fileName left join s on s.f = p.fileName""")
def jon18_targets(spark: SparkSession, d: str) -> DataFrame:
    """Files with the review decision of their document and whether an entry has them."""
    o = table(spark, d, "msds_overrides").groupBy(F.col("matchTarget.fileName").alias("f")).agg(F.min_by("reviewStatus", "override_no").alias("decision"))
    s = table(spark, d, "msds_sample").select(F.col("fileName").alias("g")).where("g is not null").distinct()
    j = table(spark, d, "pdf_inventory").join(o, F.col("fileName") == F.col("f"), "left").join(s, F.col("fileName") == F.col("g"), "left")
    return j.select("inventory_no", F.coalesce("decision", F.lit("")).alias("decision"), F.col("g").isNotNull().alias("registered"), "inventoryStatus")


@query(f"""with f as (select {_SEARCH('fileName')} as k, min(inventory_no) as inventory_no from pdf_inventory where fileName <> '' group by 1) select row_no, pageCount, textExtractStatus from msds_sample s join f on f.k = {_SEARCH('s.fileName')} join pdf_inventory using (inventory_no)""")
def jon19_file_details(spark: SparkSession, d: str) -> DataFrame:
    """The pages and state of the first file that shares an entry's file key."""
    p = table(spark, d, "pdf_inventory").where("fileName <> ''").groupBy(keys.search_key(F.col("fileName")).alias("k")).agg(F.min(F.struct("inventory_no", "pageCount", "textExtractStatus")).alias("m"))
    return table(spark, d, "msds_sample").join(p, keys.search_key(F.col("fileName")) == F.col("k")).select("row_no", "m.pageCount", "m.textExtractStatus")


@query(f"""with p as (select *, case when coalesce(trim(supplier), '') = '' then '기타 업체' else trim(supplier) end as company from (select id, first(productName order by load_no desc, row_no desc) as n, first(supplier order by load_no desc, row_no desc) as supplier from msds_sample where id is not null group by id))
  select company, count(*) as products, min(n) as first_name, max(n) as last_name, company = '기타 업체' as is_rest from p group by company""")
def agg6_companies(spark: SparkSession, d: str) -> DataFrame:
    """Entries by company, those without one last; first and last name of each."""
    company = F.when(F.coalesce(F.trim("supplier"), F.lit("")) == "", "기타 업체").otherwise(F.trim("supplier"))
    g = _live(spark, d).groupBy(company.alias("company")).agg(F.count(F.lit(1)).alias("products"), F.min("productName").alias("first_name"), F.max("productName").alias("last_name"))
    return g.withColumn("is_rest", F.col("company") == "기타 업체").orderBy("is_rest", "company")


@query("""select supplier, count(*) as todo, string_agg(distinct need, ',' order by need) as needs from (select coalesce(nullif(trim(supplier), ''), '(none)') as supplier, need from (
  select supplier, unnest(list_filter([case when coalesce(msdsNo, '') = '' then 'number' end, case when coalesce(revisionDate, '') = '' then 'date' end, case when coalesce(pdfPath, '') = '' then 'file' end], lambda x: x is not null)) as need from msds_sample)) group by supplier""")
def agg7_todo_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    """What is missing in the entries of every supplier, most first."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    need = F.array_compact(F.array(F.when(blank("msdsNo"), F.lit("number")), F.when(blank("revisionDate"), F.lit("date")), F.when(blank("pdfPath"), F.lit("file"))))
    s = table(spark, d, "msds_sample").select(F.coalesce(keys.first_filled(F.col("supplier")), F.lit("(none)")).alias("supplier"), F.explode(need).alias("need"))
    return s.groupBy("supplier").agg(F.count(F.lit(1)).alias("todo"), F.array_join(F.sort_array(F.collect_set("need")), ",").alias("needs")).orderBy(F.desc("todo"), "supplier")


_PHRASE = "select row_no, h as code, phrase, body from (select row_no, s, unnest(regexp_extract_all(s, 'H[0-9]{3}')) as h, regexp_replace(s, '^[^\\p{L}\\p{N}]*(?:H[0-9]{3}[\\s+·,]*)+', '') as body, regexp_replace(lower(regexp_replace(s, '^[^\\p{L}\\p{N}]*(?:H[0-9]{3}[\\s+·,]*)+', '')), '[^\\p{L}\\p{N}]+', '', 'g') as phrase from (select row_no, unnest(hazardStatements) as s from msds_sample where not coalesce(hazardNotClassified, false))) where trim(body) <> ''"


def phrases(s: DataFrame) -> DataFrame:
    """(row_no, code, phrase, body): every hazard statement of classified entries under each of its codes."""
    x = s.where(~F.coalesce("hazardNotClassified", F.lit(False))).select("row_no", F.explode("hazardStatements").alias("s")).where("s is not null")
    body = F.regexp_replace("s", r"^[^\p{L}\p{N}]*(?:H[0-9]{3}[\s+·,]*)+", "")
    x = x.select("row_no", F.explode(F.regexp_extract_all("s", F.lit("H[0-9]{3}"), F.lit(0))).alias("code"), body.alias("body"))
    return x.where(F.trim("body") != "").select("row_no", "code", keys.word_key(F.col("body")).alias("phrase"), "body")


_TOP = f"p as ({_PHRASE}), c as (select code, phrase, count(*) as n from p group by all), t as (select code, first(phrase order by n desc, phrase) as common, max(n) as n, cast(sum(n) as bigint) as total from c group by code having max(n) >= 3 and sum(n) >= 4)"


def usual_phrases(p: DataFrame) -> DataFrame:
    """(code, common, n, total): the most frequent phrase of every code, where it is common enough to judge others by it."""
    c = p.groupBy("code", "phrase").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("m"), "phrase")).alias("t"), F.sum("n").alias("total"))
    return t.select("code", F.col("t.phrase").alias("common"), (-F.col("t.m")).alias("n"), "total").where("n >= 3 and total >= 4")


@query(f"with {_TOP} select code, common as phrase, n, total from t")
def agg8_phrases(spark: SparkSession, d: str) -> DataFrame:
    return usual_phrases(phrases(table(spark, d, "msds_sample"))).withColumnRenamed("common", "phrase")


@query("select reviewStatus, extractStatus, count(*) as n from msds_overrides group by all")
def agg11_findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_overrides").groupBy("reviewStatus", "extractStatus").agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) as documents, count(*) filter (extractStatus = 'candidate_extracted') as extracted, count(*) filter (contains(lower(extractStatus), 'failed')) as failed, count(*) filter (len(ghsCodes) > 0) as with_codes,
  count(*) filter (len(ppeCandidates) > 0) as with_equipment, count(*) filter (coalesce(signalWordCandidate, '') <> '') as with_signal, cast(sum(extractionMeta.pageCount) as bigint) as pages, cast(sum(extractionMeta.extractedPageCount) as bigint) as read_pages, count(*) filter (extractionMeta.manualReviewRequired) as manual from msds_overrides""")
def agg12_batch_report(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col, F.count_if
    return table(spark, d, "msds_overrides").agg(
        F.count(F.lit(1)).alias("documents"), n(c("extractStatus") == "candidate_extracted").alias("extracted"), n(F.contains(F.lower("extractStatus"), F.lit("failed"))).alias("failed"), n(F.size("ghsCodes") > 0).alias("with_codes"),
        n(F.size("ppeCandidates") > 0).alias("with_equipment"), n(F.coalesce("signalWordCandidate", F.lit("")) != "").alias("with_signal"), F.sum("extractionMeta.pageCount").alias("pages"), F.sum("extractionMeta.extractedPageCount").alias("read_pages"), n("extractionMeta.manualReviewRequired").alias("manual"),
    )


@query(f"""with w as (select doc_id, unnest(list_filter(string_split(trim(regexp_replace(l, '[{_B}]+', ' ', 'g')), ' ')[2:-2], lambda x: x <> '')) as w from (select doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null))
  select doc_id, count(distinct w) as words from w group by doc_id""")
def agg14_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Different words of every document that stand inside a line, where no line break can have cut them."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    ws = F.split(F.trim(F.regexp_replace("l", f"[{_B}]+", " ")), " ")
    inner = lines.select("doc_id", ws.alias("ws")).where("size(ws) > 2").select("doc_id", F.explode(F.expr("slice(ws, 2, size(ws) - 2)")).alias("w")).where("w <> ''")
    return inner.groupBy("doc_id").agg(F.countDistinct("w").alias("words"))


@query("""select code, k, body from (select code, k, body, row_number() over (partition by code, k order by row_no, pos) as r from (select row_no, pos, substr(s, 1, 4) as code, regexp_replace(substr(s, 6), '\\s', '', 'g') as k, substr(s, 6) as body
  from (select row_no, generate_subscripts(hazardStatements, 1) as pos, unnest(hazardStatements) as s from msds_sample) where regexp_matches(s, '^H[0-9]{3} ') and length(regexp_replace(s, '[^ ]', '', 'g')) >= 4)) where r = 1""")
def agg15_spacing_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The first well-spaced writing of every coded statement, by its letters without blanks."""
    s = table(spark, d, "msds_sample").select("row_no", F.posexplode("hazardStatements").alias("pos", "s")).where(F.col("s").rlike("^H[0-9]{3} ") & (F.length(F.regexp_replace("s", "[^ ]", "")) >= 4))
    return s.groupBy(F.substring("s", 1, 4).alias("code"), F.regexp_replace(F.substring("s", 6, 1 << 20), r"\s", "").alias("k")).agg(F.min_by(F.substring("s", 6, 1 << 20), F.struct("row_no", "pos")).alias("body"))


@query("""select count(*) filter (coalesce(revisionDate, '') <> '' and not regexp_full_match(trim(revisionDate), '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as odd_dates, count(*) filter (coalesce(trim(revisionDate), '') = '') as no_dates,
  (select count(*) from (select erpName from msds_sample where erpName <> '' group by erpName having count(distinct id) > 1)) as shared_erp_names from msds_sample""")
def agg18_counters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "msds_sample")
    v = F.coalesce("revisionDate", F.lit(""))
    shared = s.where("erpName <> ''").groupBy("erpName").agg(F.countDistinct("id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_erp_names"))
    return s.agg(F.count_if((v != "") & ~F.trim("revisionDate").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("odd_dates"), F.count_if(F.trim(v) == "").alias("no_dates")).join(shared)


@query("""select productName, count(distinct id) as entries from msds_sample where productName is not null group by productName having count(distinct id) > 1""")
def agg19_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").where("productName is not null").groupBy("productName").agg(F.countDistinct("id").alias("entries")).where("entries > 1")


@query("select regexp_replace(relativePath, '/?[^/]*$', '') as folder, count(*) as files, cast(sum(fileSize) as bigint) as bytes from pdf_inventory group by 1")
def agg20_folders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_inventory").groupBy(F.regexp_replace("relativePath", "/?[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("fileSize").alias("bytes"))


@query("""select count(*) as deliveries, count(distinct id) as entries, count(*) filter (coalesce(msdsNo, '') = '') as without_number, count(*) filter (coalesce(pdfPath, '') = '') as without_path, count(*) filter (coalesce(supplier, '') = '') as without_supplier,
  count(*) filter (hazardNotClassified) as not_classified, (select count(*) from pdf_inventory) as files, (select count(distinct sha256) from pdf_inventory) as contents, (select count(*) from msds_overrides) as documents,
  (select count(*) from msds_overrides where reviewStatus = '승인') as approved, (select count(*) from msds_overrides where contains(lower(extractStatus), 'failed')) as failed, (select count(*) from msds_ingredient) as lines from msds_sample""")
def agg3_workflow_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all tables in one row; every table is read once and gives one row."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    n = F.count(F.lit(1))
    s = table(spark, d, "msds_sample").agg(n.alias("deliveries"), F.countDistinct("id").alias("entries"), blank("msdsNo").alias("without_number"), blank("pdfPath").alias("without_path"), blank("supplier").alias("without_supplier"), F.count_if("hazardNotClassified").alias("not_classified"))
    p = table(spark, d, "pdf_inventory").agg(n.alias("files"), F.countDistinct("sha256").alias("contents"))
    o = table(spark, d, "msds_overrides").agg(n.alias("documents"), F.count_if(F.col("reviewStatus") == "승인").alias("approved"), F.count_if(F.contains(F.lower("extractStatus"), F.lit("failed"))).alias("failed"))
    return s.join(p).join(o).join(table(spark, d, "msds_ingredient").agg(n.alias("lines")))


@query("""select row_no, last_value(case when item_no = 1 then chemicalName end ignore nulls) over (partition by row_no order by item_no rows unbounded preceding) as parent, item_no from (select distinct row_no, item_no, first_value(chemicalName) over (partition by row_no, item_no order by casNo, content) as chemicalName from msds_ingredient)""")
def win1_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every ingredient line with the first line of its delivery above it. Groups are the few lines of one delivery."""
    i = table(spark, d, "msds_ingredient").groupBy("row_no", "item_no").agg(F.min_by("chemicalName", F.struct(F.col("casNo").isNull(), "casNo", F.col("content").isNull(), "content")).alias("chemicalName"))
    w = Window.partitionBy("row_no").orderBy("item_no").rowsBetween(Window.unboundedPreceding, 0)
    return i.select("row_no", F.last(F.when(F.col("item_no") == 1, F.col("chemicalName")), ignorenulls=True).over(w).alias("parent"), "item_no")


@query("""select id, row_no, productName from (select id, row_no, productName, row_number() over (partition by id order by row_no) as r from msds_sample where id is not null) where r = 1""")
def win3_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.min(F.struct("row_no", "productName")).alias("m")).select("id", "m.row_no", "m.productName")


@query("""with s as (select row_no, dataSource, case when dataSource is distinct from lag(dataSource) over (order by row_no) or lag(row_no) over (order by row_no) is null then 1 else 0 end as start from msds_sample), b as (select *, sum(start) over (order by row_no) as block from s)
  select min(row_no) as first_row, max(row_no) as last_row, any_value(dataSource) as dataSource from b group by block""")
def win5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive rows of one source. A run ends where the next begins, so only the starts are ordered again."""
    s = table(spark, d, "msds_sample").select("row_no", "dataSource").withColumn("all", F.lit(0))
    p = previous(s, ["all"], ["row_no"], ["row_no", "dataSource"])
    starts = p.where(F.col("prev").isNull() | ~F.col("dataSource").eqNullSafe(F.col("prev.dataSource"))).select("all", "row_no", "dataSource", F.col("prev.row_no").alias("before"))
    ends = previous(starts.withColumn("neg", -F.col("row_no")), ["all"], ["neg"], ["before"])
    last = s.agg(F.max("row_no").alias("last"))
    return ends.join(last).select(F.col("row_no").alias("first_row"), F.coalesce("prev.before", "last").alias("last_row"), "dataSource")


@query("""select row_no, id, load_no, lag(load_no) over w as before_load, lag(supplier) over w as before_supplier from msds_sample where id is not null window w as (partition by id order by load_no, row_no)""")
def win7_previous_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with the one of its entry before it."""
    s = table(spark, d, "msds_sample").where("id is not null").select("row_no", "id", "load_no", "supplier")
    return previous(s, ["id"], ["load_no", "row_no"], ["load_no", "supplier"]).select("row_no", "id", "load_no", F.col("prev.load_no").alias("before_load"), F.col("prev.supplier").alias("before_supplier"))


@query("select row_no, item_no, row_number() over (partition by row_no order by item_no, chemicalName, casNo, content) as place from msds_ingredient where chemicalName is not null and casNo is not null and content is not null")
def win6_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of the lines of a delivery, counted anew."""
    w = Window.partitionBy("row_no").orderBy("item_no", "chemicalName", "casNo", "content")
    return table(spark, d, "msds_ingredient").where("chemicalName is not null and casNo is not null and content is not null").select("row_no", "item_no", F.row_number().over(w).cast("bigint").alias("place"))


@query("""select id, last_seen from (select id, max(loaded_at) as last_seen from msds_sample where id is not null group by id order by last_seen desc, id limit 8)""")
def win9_recent(spark: SparkSession, d: str) -> DataFrame:
    """The eight entries delivered last."""
    return table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max("loaded_at").alias("last_seen")).orderBy(F.desc("last_seen"), "id").limit(8)


@query("""with t as (select override_no, reviewStatus in ('검토필요', '자동추출') as open from msds_overrides), n as (select max(override_no) as n from t)
  select from_no, first(override_no order by (override_no - from_no - 1 + n) % n) as next_no from (select unnest([0, 100, 500, 1300]) as from_no), t, n where open group by from_no""")
def win10_next_open(spark: SparkSession, d: str) -> DataFrame:
    """The next document to review after each of some places, from the start again after the last."""
    o = table(spark, d, "msds_overrides")
    n = o.agg(F.max("override_no").alias("n"))
    t = o.where(F.col("reviewStatus").isin("검토필요", "자동추출")).join(n).select("override_no", "n", F.explode(F.array(*[F.lit(x) for x in (0, 100, 500, 1300)])).alias("from_no"))
    return t.groupBy("from_no").agg(F.min_by("override_no", F.pmod(F.col("override_no") - F.col("from_no") - 1, F.col("n"))).alias("next_no"))


@query("""select path, case when o is null then 'added' when n is null then 'removed' when o is distinct from n then 'changed' else 'same' end as change from (select coalesce(a.path, b.path) as path, a.s as o, b.s as n from
  (select matchTarget.relativePath as path, coalesce(first(reviewStatus order by override_no), '') as s from msds_overrides where matchTarget.relativePath <> '' group by 1) a full join
  (select matchTarget.relativePath as path, coalesce(first(reviewStatus order by override_no desc), '') as s from msds_overrides where matchTarget.relativePath <> '' and reviewedAt is not null group by 1) b on a.path = b.path)""")
def set2_compare_queues(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the review queue: all documents by their first decision, reviewed ones by their last."""
    o = table(spark, d, "msds_overrides").withColumn("path", F.col("matchTarget.relativePath")).where("path <> ''")
    a = o.groupBy("path").agg(F.coalesce(F.min_by("reviewStatus", "override_no"), F.lit("")).alias("o"))
    b = o.where("reviewedAt is not null").groupBy("path").agg(F.coalesce(F.max_by("reviewStatus", "override_no"), F.lit("")).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


_LAST = "(select max(load_no) from msds_sample)"


@query(f"""select id, kind from (select distinct id, 'built' as kind from msds_sample where load_no = {_LAST} and id is not null union all select distinct id, 'carried' from msds_sample s where load_no < {_LAST} and id is not null and not exists (select 1 from msds_sample b where b.load_no = {_LAST} and b.id = s.id)
  and not exists (select 1 from msds_sample b where b.load_no = {_LAST} and b.fileName = s.fileName))""")
def set4_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the last load, and earlier ones that share neither id nor file with it."""
    s = table(spark, d, "msds_sample").where("id is not null")
    last = s.agg(F.max("load_no").alias("m"))
    tagged = s.join(F.broadcast(last))
    built, old = tagged.where("load_no = m"), tagged.where("load_no < m")
    kept = old.join(built.select("id"), "id", "left_anti").join(built.select("fileName").where("fileName is not null"), "fileName", "left_anti")
    return built.select("id").distinct().withColumn("kind", F.lit("built")).unionByName(kept.select("id").distinct().withColumn("kind", F.lit("carried")))


@query("select fileName, source from (select fileName, 'inventory' as source from pdf_inventory union all select matchTarget.fileName, 'document' from msds_overrides)")
def set5_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_inventory").select("fileName", F.lit("inventory").alias("source")).unionByName(table(spark, d, "msds_overrides").select(F.col("matchTarget.fileName").alias("fileName"), F.lit("document").alias("source")))


_EDITED = ["productName", "supplier", "msdsNo"]


@query("select id, row_no, " + "array_to_string(list_filter([" + ", ".join(f"case when coalesce({f}, '') <> coalesce(lag({f}) over w, '') then '{f}' end" for f in _EDITED) + "], lambda x: x is not null), ',') as changed from msds_sample where id is not null window w as (partition by id order by load_no, row_no) qualify lag(row_no) over w is not null")
def set7_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a delivery changed against the one before; empty equals missing."""
    s = table(spark, d, "msds_sample").where("id is not null").select("id", "load_no", "row_no", *_EDITED)
    p = previous(s, ["id"], ["load_no", "row_no"], ["row_no", *_EDITED]).where("prev is not null")
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return p.select("id", "row_no", F.array_join(F.array_compact(F.array(*[F.when(e(f) != e(f"prev.{f}"), F.lit(f)) for f in _EDITED])), ",").alias("changed"))


@query("select row_no, case when b is null or b = v then v else b || ' → ' || v end as cell from (select row_no, coalesce(supplier, '') as v, lag(coalesce(supplier, '')) over (partition by id order by load_no, row_no) as b from msds_sample where id is not null)")
def set8_history_cells(spark: SparkSession, d: str) -> DataFrame:
    """A value beside the one before it, where they differ."""
    s = table(spark, d, "msds_sample").where("id is not null").select("id", "load_no", "row_no", F.coalesce("supplier", F.lit("")).alias("v"))
    p = previous(s, ["id"], ["load_no", "row_no"], ["v"])
    b = F.col("prev.v")
    return p.select("row_no", F.when(b.isNull() | (b == F.col("v")), F.col("v")).otherwise(F.concat(b, F.lit(" → "), F.col("v"))).alias("cell"))


@query("""select pdfPath, count(distinct id) as ids, min(id) as first_id from msds_sample where pdfPath <> '' and id is not null group by pdfPath having count(distinct id) > 1""")
def set9_stale_ids(spark: SparkSession, d: str) -> DataFrame:
    """Files under which an entry changed its id."""
    return table(spark, d, "msds_sample").where("pdfPath <> '' and id is not null").groupBy("pdfPath").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("first_id")).where("ids > 1")


@query("""with l as (select lower(fileName) as n, sha256 as h, inventory_no, inventoryStatus as st from pdf_inventory), old as (select * from l where st <> 'unmatched'), new as (select * from l where st = 'unmatched')
  select inventory_no, array_to_string(list_filter([case when h in (select h from old where h is not null) then 'same content in library' end, case when n in (select n from old where n is not null) then 'same name in library' end,
    case when count(h) over (partition by h) > 1 then 'same content in batch' end, case when count(n) over (partition by n) > 1 then 'same name in batch' end], lambda x: x is not null), ' / ') as issue from new""")
def set3_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Files that no entry matches, as a batch of arriving ones, against the library, which are the others."""
    from vialworks.streaming.incoming import classify

    p = table(spark, d, "pdf_inventory")
    return classify(p.where("inventoryStatus = 'unmatched'").select("inventory_no", "fileName", "sha256"), p.where("inventoryStatus <> 'unmatched'")).select("inventory_no", "issue")


@query("""select override_no, row_number() over (order by reviewStatus nulls last, matchTarget.relativePath nulls last, override_no) as place from msds_overrides order by place limit 40""")
def top9_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first forty documents of the review queue, by status and path."""
    order = [F.col("reviewStatus").asc_nulls_last(), F.col("matchTarget.relativePath").asc_nulls_last(), "override_no"]
    first = table(spark, d, "msds_overrides").orderBy(*order).limit(40)
    return first.select("override_no", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query(f"select id, productName from (select id, first(productName order by load_no desc, row_no desc) as productName from msds_sample where id is not null group by id) where contains({_sql_key('productName', r'()[]{}_-/'.replace('[', chr(92) + '[').replace(']', chr(92) + ']').replace('-', chr(92) + '-'))}, '세') order by productName, id limit 8")
def top10_pick_assist(spark: SparkSession, d: str) -> DataFrame:
    """Eight entries whose name holds what was typed."""
    return _live(spark, d).where(F.contains(keys.page_key(F.col("productName")), F.lit("세"))).orderBy("productName", "id").limit(8).select("id", "productName")


@query(f"with {_LIVE} select l.id, list_position(['위험', '경고'], coalesce(signal, '')) as status_order from live l join (select id, first(signalWord order by load_no desc, row_no desc) as signal from msds_sample where id is not null group by id) g using (id) order by coalesce(status_order, 9), supplier, productName, l.id limit 50")
def top11_register_order(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty entries by signal word, supplier and name."""
    s = table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max(F.struct("load_no", "row_no", "signalWord", "supplier", "productName")).alias("m")).select("id", "m.*")
    at = F.array_position(F.array(F.lit("위험"), F.lit("경고")), F.coalesce("signalWord", F.lit("")))
    r = s.select("id", F.when(at > 0, at).cast("int").alias("status_order"), "supplier", "productName")
    return r.orderBy(F.coalesce("status_order", F.lit(9)), F.col("supplier").asc_nulls_last(), F.col("productName").asc_nulls_last(), "id").limit(50).select("id", "status_order")


@query("""with s as (select row_no, rule, level from (select row_no, 'no_number' as rule, 1 as level from msds_sample where coalesce(msdsNo, '') = '' union all select row_no, 'no_date', 2 from msds_sample where coalesce(revisionDate, '') = '')) select *, row_number() over (order by level, rule, row_no) as place from s order by place limit 30""")
def top7_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty findings by level, rule and entry."""
    s = table(spark, d, "msds_sample")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    f = s.where(blank("msdsNo")).select("row_no", F.lit("no_number").alias("rule"), F.lit(1).alias("level")).unionByName(s.where(blank("revisionDate")).select("row_no", F.lit("no_date").alias("rule"), F.lit(2).alias("level")))
    return f.orderBy("level", "rule", "row_no").limit(30).withColumn("place", F.row_number().over(Window.orderBy("level", "rule", "row_no")).cast("bigint"))


@query("select override_no from msds_overrides where reviewStatus in ('검토필요', '수정필요') and contains(lower(concat_ws(' ', matchTarget.fileName, productNameCandidate, supplierCandidate)), '제')")
def flt6_queue(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.concat_ws(" ", "matchTarget.fileName", "productNameCandidate", "supplierCandidate"))
    return table(spark, d, "msds_overrides").where(F.col("reviewStatus").isin("검토필요", "수정필요") & holds(t, ["제"])).select("override_no")


@query(f"with {_LIVE} select l.id from live l where supplier <> '' and contains({_sql_key('concat_ws(chr(32), l.productName, supplier)', chr(92) + '(' + chr(92) + ')' + chr(92) + '[' + chr(92) + ']{}_' + chr(92) + '-/')}, '상사')")
def flt5_register(spark: SparkSession, d: str) -> DataFrame:
    """Live entries with a supplier whose name or supplier holds a word."""
    return _live(spark, d).where((F.col("supplier") != "") & F.contains(keys.page_key(F.concat_ws(" ", "productName", "supplier")), F.lit("상사"))).select("id")


@query("select override_no, lower(extractStatus) in ('failed', 'text_extract_failed', 'pypdf_import_failed') or contains(lower(extractStatus), 'failed') or contains(lower(coalesce(extractionMeta.error, '')), 'import_failed') as failed, extractStatus in ('text_missing', 'scanned_pdf_or_image_pdf') as no_text, reviewStatus in ('검토필요', '자동추출') as to_review from msds_overrides")
def flt11_failed(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower("extractStatus")
    return table(spark, d, "msds_overrides").select("override_no", (F.contains(s, F.lit("failed")) | F.contains(F.lower(F.coalesce("extractionMeta.error", F.lit(""))), F.lit("import_failed"))).alias("failed"), F.col("extractStatus").isin("text_missing", "scanned_pdf_or_image_pdf").alias("no_text"), F.col("reviewStatus").isin("검토필요", "자동추출").alias("to_review"))


@query("select override_no from msds_overrides where reviewStatus = '제외' and (regexp_matches(coalesce(extractionMeta.error, ''), 'QR|안내|비MSDS') or len(ghsCodes) = 0)")
def flt13_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Excluded documents that are no safety sheets: for a stated reason, or without any code."""
    return table(spark, d, "msds_overrides").where((F.col("reviewStatus") == "제외") & (F.coalesce("extractionMeta.error", F.lit("")).rlike("QR|안내|비MSDS") | (F.size("ghsCodes") == 0))).select("override_no")


@query("select inventory_no from pdf_inventory p where textExtractStatus <> 'ok' or not exists (select 1 from msds_overrides o where o.matchTarget.fileName = p.fileName)")
def flt14_targets(spark: SparkSession, d: str) -> DataFrame:
    """Files to read: those that failed, and those without a document."""
    p, o = table(spark, d, "pdf_inventory"), table(spark, d, "msds_overrides").select(F.col("matchTarget.fileName").alias("fileName"))
    return p.where("textExtractStatus <> 'ok'").select("inventory_no").unionByName(p.join(o, "fileName", "left_anti").select("inventory_no")).distinct()


@query("select row_no, coalesce(len(hazardStatements), 0) > 0 or coalesce(len(ghsCodes), 0) > 0 or coalesce(trim(ppeSummary), '') <> '' or coalesce(trim(signalWord), '') <> '' as has_summary from msds_sample")
def flt10_has_summary(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return table(spark, d, "msds_sample").select("row_no", (some("hazardStatements") | some("ghsCodes") | filled("ppeSummary") | filled("signalWord")).alias("has_summary"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by their latest delivery, with their distinct registry numbers."""
    s = table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max(F.struct("load_no", "row_no", "fileName", "productName", "erpName", "msdsNo")).alias("m"))
    cas = table(spark, d, "msds_ingredient").where(text.valid_cas(F.trim("casNo"))).groupBy(F.col("productId").alias("id")).agg(F.array_sort(F.collect_set(F.trim("casNo"))).alias("cas"))
    return s.select("id", F.col("m.fileName").alias("file"), F.col("m.productName").alias("name"), F.col("m.erpName").alias("erp"), F.col("m.msdsNo").alias("number")).join(cas, "id", "left")


@query()
def jon5_scored_matches(spark: SparkSession, d: str) -> DataFrame:
    """Files of the library that fit an entry, by all reasons that the tables can feed; all that reach the least score."""
    from vialworks.operators import matching

    p = table(spark, d, "pdf_inventory").select(F.col("inventory_no").alias("document"), F.col("fileName").alias("file"), F.col("productNameCandidates").alias("names"), F.array().cast("array<string>").alias("numbers"), F.col("casNoCandidates").alias("cas"))
    return matching.scored_matches(_entries(spark, d), p)


@query()
def scl4_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different name keys of entries and files that are alike."""
    from vialworks.operators import matching

    k = lambda c: keys.match_key(c).alias("k")
    return matching.similar_names(_entries(spark, d).select(k(F.col("name"))).where("k is not null"), table(spark, d, "pdf_inventory").select(F.explode("productNameCandidates").alias("n")).select(k(F.col("n"))).where("k is not null"))


@query()
def rul15_link_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of every entry's link: exact, by key, one good candidate, several, weak, none."""
    m = jon5_scored_matches(spark, d)
    best = m.groupBy("id").agg(F.max("score").alias("score"), F.count_if(F.contains("reasons", F.lit("same_file"))).alias("exact"), F.count_if(F.contains("reasons", F.lit("file_key"))).alias("by_key"), F.count_if(F.col("tier") != "weak").alias("good"))
    status = F.when(F.col("exact") > 0, "exact").when(F.col("by_key") > 0, "normalised").when(F.col("good") > 1, "multiple").when(F.col("good") == 1, "probable").when(F.col("score").isNotNull(), "weak").otherwise("pdf_missing")
    return _entries(spark, d).select("id").join(best, "id", "left").select("id", status.alias("status"), F.coalesce("score", F.lit(0)).alias("score"))
