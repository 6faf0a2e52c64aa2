"""Queries of the catalogue operators over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.functions import keys, text
from vialworks.operators import catalogue as op
from vialworks.operators.ordered import previous
from vialworks.sources.tables import table

FLAGS = ["managementTarget", "workplaceMonitoringTarget", "specialHealthCheckTarget"]
REVIEW = ["검토필요", "자동추출", "승인", "보류", "수정필요", "제외"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_B = r"\s\x{3000}\x{a0}"


def _sql_key(c: str, marks: str) -> str:
    return f"regexp_replace(lower({c}), '[{_B}{marks}]', '', 'g')"


_SEARCH = lambda c: _sql_key(f"regexp_replace(lower({c}), '\\.pdf', '', 'g')", r"()\[\]{}<>（）［］｛｝_\-/\\")
_MATCH = lambda c: _sql_key(f"regexp_replace(lower({c}), '\\.pdf$', '')", r"()\[\]{}<>_\-/\\.,:;")
_BASE = lambda c: f"list_extract(string_split(replace({c}, '\\', '/'), '/'), -1)"
_CAS = """(regexp_full_match({c}, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') and list_sum(list_transform(range(1, length(replace({c}, '-', ''))), lambda i:
  try_cast(substr(replace({c}, '-', ''), cast(length(replace({c}, '-', '')) - i as int), 1) as int) * i)) % 10 = try_cast(right({c}, 1) as int))"""


@query(rf"""select row_no, {_SEARCH('productName')} as k_search, {_sql_key('productName', r'()\[\]{}_\-/\\')} as k_page, {_MATCH('fileName')} as k_match,
  regexp_replace(lower(productName), '[^\p{{L}}\p{{N}}]+', '', 'g') as k_word, {_sql_key('productName', r',，/\\_\-()（）')} as k_name,
  regexp_replace(replace(trim(pdfPath), '\', '/'), '^/+', '') as k_path, regexp_replace(supplierAddress, '[{_B},.·ㆍ∙]', '', 'g') as k_paragraph,
  regexp_replace(trim(regexp_replace(siteLabel, '[{_B}]+', ' ', 'g')), '[0-9]+', '#', 'g') as k_line, regexp_replace(siteLabel, '[{_B}.,·/]', '', 'g') as k_item from msds_sample""")
def prj_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "msds_sample").select(
        "row_no", keys.search_key(c("productName")).alias("k_search"), keys.page_key(c("productName")).alias("k_page"), keys.match_key(c("fileName")).alias("k_match"),
        keys.word_key(c("productName")).alias("k_word"), keys.name_key(c("productName")).alias("k_name"), keys.path_key(c("pdfPath")).alias("k_path"),
        keys.paragraph_key(c("supplierAddress")).alias("k_paragraph"), keys.line_key(c("siteLabel")).alias("k_line"), keys.item_key(c("siteLabel")).alias("k_item"),
    )


@query(rf"""select inventory_no, case when regexp_full_match(sha256, '[a-fA-F0-9]{{64}}') then 'hash:' || lower(sha256) else {_SEARCH(_BASE('sha256'))} end as k_hash,
  {_SEARCH(_BASE('pdfPath'))} as k_file from pdf_inventory""")
def prj_identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_inventory").select("inventory_no", keys.identity_key(F.col("sha256")).alias("k_hash"), keys.search_key(keys.base_name(F.col("pdfPath"))).alias("k_file"))


@query("""select row_no, case when p = '' then '' when regexp_matches(p, '^(https?:|pdf/)') then p else 'pdf/' || p end as public_path,
  coalesce(nullif(trim(productName), ''), nullif(trim(erpName), ''), fileName) as shown_name
  from (select *, regexp_replace(replace(trim(pdfPath), '\\', '/'), '^/+', '') as p from msds_sample)""")
def prj_public_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", keys.pdf_path(F.col("pdfPath")).alias("public_path"), keys.first_filled(F.col("productName"), F.col("erpName"), F.col("fileName")).alias("shown_name"))


@query(f"select row_no, item_no, coalesce({_CAS.format(c='trim(casNo)')}, false) as is_valid from msds_ingredient")
def scl1_valid_cas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_ingredient").select("row_no", "item_no", text.valid_cas(F.trim("casNo")).alias("is_valid"))


@query(rf"""select doc_id, count(t) as n_cas, count(distinct t) as n_distinct from (
  select doc_id, t from (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[^0-9A-Za-z_-]+')) as t from documents) where {_CAS.format(c='t')}) group by doc_id""")
def scl2_extract_cas(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", text.extract_cas(F.col("text")).alias("c")).where("size(c) > 0")
    return found.select("doc_id", F.size("c").cast("bigint").alias("n_cas"), F.size(F.array_distinct("c")).cast("bigint").alias("n_distinct"))


@query("""select row_no, array_to_string(list_transform(string_split(lower(productName), ''), lambda x: case when x between '가' and '힣'
  then substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', cast(floor((unicode(x) - 44032) / 588) as int) + 1, 1) else x end), '') as initials from msds_sample where productName is not null""")
def scl10_initials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").where("productName is not null").select("row_no", text.initials(F.col("productName")).alias("initials"))


_ALIASES = ", ".join(f"('{w}', '{c}')" for w, c in text.PICTOGRAM_OF.items())


@query(f"""with a(w, c) as (values {_ALIASES}, {", ".join(f"('ghs0{i}', 'GHS0{i}')" for i in range(1, 10))}),
  x as (select row_no, unnest(ghsCodes) as g from msds_sample)
  select row_no, string_agg(distinct a.c, ',' order by a.c) as codes from x join a on a.w = regexp_replace(lower(g), '[^\\p{{L}}\\p{{N}}]', '', 'g') group by row_no""")
def scl32_pictograms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "msds_sample").select("row_no", F.array_join(text.pictograms(F.col("ghsCodes")), ",").alias("codes"))
    return p.where("codes <> ''")


@query("""select row_no, case when least(length(a), length(b)) < 2 then 0.0 else round(len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))), 9) end as similarity
  from (select row_no, a, b, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, cast(i as int), 2))) as x,
    list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, cast(i as int), 2))) as y
    from (select row_no, lower(productName) as a, lower(fileName) as b from msds_sample where productName is not null and fileName is not null))""")
def scl7_bigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "msds_sample").where("productName is not null and fileName is not null")
    return s.select("row_no", F.round(text.bigram_similarity(F.lower("productName"), F.lower("fileName")), 9).alias("similarity"))


@query("select w.value, count(o.reviewStatus) as n from (values " + ", ".join(f"('{v}')" for v in REVIEW) + ") w(value) left join msds_overrides o on o.reviewStatus = w.value group by all")
def agg2_review_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.count_by_vocabulary(table(spark, d, "msds_overrides"), "reviewStatus", REVIEW)


@query("""select inventoryStatus, textExtractStatus, count(*) as files, cast(sum(fileSize) as bigint) as bytes, cast(sum(pageCount) as bigint) as pages,
  count(*) filter (len(casNoCandidates) > 0) as with_cas from pdf_inventory group by all""")
def agg4_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_inventory").groupBy("inventoryStatus", "textExtractStatus").agg(
        F.count(F.lit(1)).alias("files"), F.sum("fileSize").alias("bytes"), F.sum("pageCount").alias("pages"), F.count_if(F.size("casNoCandidates") > 0).alias("with_cas")
    )


@query("""select 'sha256' as kind, sha256 as key, count(*) as members, min(inventory_no) as first_member from pdf_inventory where sha256 <> '' group by sha256 having count(*) > 1
  union all select 'file_name', lower(fileName), count(*), min(inventory_no) from pdf_inventory where fileName <> '' group by lower(fileName) having count(*) > 1
  union all select 'cas_list', array_to_string(list_sort(casNoCandidates), ','), count(*), min(inventory_no) from pdf_inventory where len(casNoCandidates) >= 3
    group by array_to_string(list_sort(casNoCandidates), ',') having count(*) > 1""")
def agg5_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_inventory")
    cas = F.when(F.size("casNoCandidates") >= 3, F.array_join(F.array_sort("casNoCandidates"), ","))
    return op.duplicate_groups(p, F.col("sha256"), "inventory_no", "sha256").unionByName(op.duplicate_groups(p, F.lower("fileName"), "inventory_no", "file_name")).unionByName(op.duplicate_groups(p, cas, "inventory_no", "cas_list"))


@query(rf"""select k as line, count(distinct doc_id) as docs from (select doc_id, regexp_replace(trim(regexp_replace(l, '[{_B}]+', ' ', 'g')), '[0-9]+', '#', 'g') as k
  from (select doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null)) where k <> '' group by k having count(distinct doc_id) >= 5""")
def agg13_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    k = lines.select("doc_id", keys.line_key(F.col("l")).alias("line")).where("line <> ''")
    return k.groupBy("line").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 5")


@query()
def agg17_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return op.library_fingerprint(table(spark, d, "pdf_inventory"), "relativePath", "sha256")


@query("""select sha256, inventory_no, relativePath from (select *, row_number() over (partition by sha256 order by length(relativePath), relativePath, inventory_no) as r from pdf_inventory where sha256 is not null) where r = 1""")
def win2_canonical_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_inventory").where("sha256 is not null")
    return op.elect(p, F.col("sha256"), [F.length("relativePath"), F.col("relativePath"), F.col("inventory_no")], ["sha256", "inventory_no", "relativePath"])


@query("""select id, row_no, versions, first_load_no from (select id, row_no, count(*) over (partition by id) as versions, min(load_no) over (partition by id) as first_load_no,
  row_number() over (partition by id order by load_no desc, loaded_at desc, row_no desc) as r from msds_sample where id is not null) where r = 1""")
def agg9_versions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "msds_sample").where("id is not null").groupBy("id")
    return g.agg(F.max_by("row_no", F.struct("load_no", "loaded_at", "row_no")).alias("row_no"), F.count(F.lit(1)).alias("versions"), F.min("load_no").alias("first_load_no"))


@query("""select productId, override_no, reviewStatus from (select *, row_number() over (partition by productId order by reviewedAt desc, override_no desc) as r from msds_overrides where reviewedAt is not null and productId is not null) where r = 1""")
def win8_latest_review(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "msds_overrides").where("reviewedAt is not null and productId is not null")
    return o.groupBy("productId").agg(F.max(F.struct("reviewedAt", "override_no", "reviewStatus")).alias("m")).select("productId", "m.override_no", "m.reviewStatus")


_JON1 = " union all ".join(
    f"select row_no, {p} as p, '{kind}' as kind, {k} as key from msds_sample" for p, (kind, k) in enumerate([("file", "lower(fileName)"), ("number", "msdsNo"), ("name", "lower(productName)"), ("path", f"lower({_BASE('pdfPath')})")])
)
_JON1R = " union all ".join(
    f"select override_no, '{kind}' as kind, {k} as key from msds_overrides"
    for kind, k in [("file", "lower(matchTarget.fileName)"), ("number", "matchTarget.msdsNo"), ("name", "lower(matchTarget.productName)"), ("path", f"lower({_BASE('sourcePdfPath')})")]
)


@query(f"""with l as ({_JON1}), r as (select kind, key, min(override_no) as override_no from ({_JON1R}) where key <> '' group by all)
  select row_no, override_no, kind as matched_by from (select l.row_no, r.override_no, l.kind, row_number() over (partition by l.row_no order by p, r.override_no) as n from l join r using (kind, key)) where n = 1""")
def jon1_overrides(spark: SparkSession, d: str) -> DataFrame:
    s, o, c = table(spark, d, "msds_sample"), table(spark, d, "msds_overrides"), F.col
    return op.priority_join(
        s, "row_no", [("file", F.lower("fileName")), ("number", c("msdsNo")), ("name", F.lower("productName")), ("path", F.lower(keys.base_name(c("pdfPath"))))],
        o, "override_no", [("file", F.lower("matchTarget.fileName")), ("number", c("matchTarget.msdsNo")), ("name", F.lower("matchTarget.productName")), ("path", F.lower(keys.base_name(c("sourcePdfPath"))))],
    )


@query("""with n as (select id, lower(n) as n from (select id, first(productName order by load_no desc, row_no desc) as n from msds_sample where id is not null group by id) where length(n) >= 6),
  c as (select a.id as ia, a.n as a, b.n as b, list_max(list_filter(range(0, least(length(a.n), length(b.n)) + 1), lambda k: left(a.n, cast(k as int)) = left(b.n, cast(k as int)))) as common
    from n a join n b on a.id <> b.id and left(a.n, 6) = left(b.n, 6))
  select ia as id, count(*) as partners, max(common) as prefix from c where common >= 6 and common >= 0.3 * least(length(a), length(b)) group by ia""")
def jon9_lookalikes(spark: SparkSession, d: str) -> DataFrame:
    """Entries by their latest name."""
    live = table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max(F.struct("load_no", "row_no", "productName")).alias("m")).select("id", "m.productName")
    return op.lookalikes(live, "id", "productName")


_OLD = "select relativePath as p, min(sha256) as d from pdf_inventory where relativePath is not null group by relativePath"
_NEW = "select regexp_replace(pdfPath, '^/?pdf/', '') as p, min(sha256) as d from pdf_inventory where pdfPath is not null group by 1"


@query(f"""with o as ({_OLD}), n as ({_NEW}) select coalesce(o.p, n.p) as relativePath, case when n.p is null then 'deleted_from_source' when o.d = n.d then 'unchanged'
  when o.p is not null then 'changed_same_path' when n.d in (select d from o) then 'moved_or_renamed_candidate' else 'new_file' end as status,
  case when n.p is null then coalesce((select count(*) from n m where m.d = o.d), 0) when o.p is null then coalesce((select count(*) from o m where m.d = n.d), 0) else 0 end as candidates from o full join n on o.p = n.p""")
def set1_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """The folder as it is listed against the library's published paths, with the number of files of the same content."""
    p = table(spark, d, "pdf_inventory")
    old = p.where("relativePath is not null").groupBy("relativePath").agg(F.min("sha256").alias("sha256"))
    new = p.where("pdfPath is not null").groupBy(F.regexp_replace("pdfPath", "^/?pdf/", "").alias("relativePath")).agg(F.min("sha256").alias("sha256"))
    return op.snapshot_diff(old, new, "relativePath", "sha256")


@query("""select id, min(load_no) as load_no, list_sort(list_filter(b, lambda x: not list_contains(a, x))) as added, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as removed from (
  select id, load_no, ghsCodes as b, lag(ghsCodes) over (partition by id order by load_no, row_no) as a from msds_sample where id is not null) where a is not null and b is not null
  and (len(list_filter(b, lambda x: not list_contains(a, x))) > 0 or len(list_filter(a, lambda x: not list_contains(b, x))) > 0) group by all""")
def set6_code_changes(spark: SparkSession, d: str) -> DataFrame:
    """Codes that a delivery adds to or removes from those of the one before."""
    s = table(spark, d, "msds_sample").where("id is not null").select("id", "load_no", "row_no", "ghsCodes")
    p = previous(s, ["id"], ["load_no", "row_no"], ["ghsCodes"]).select("id", "load_no", F.col("ghsCodes").alias("b"), F.col("prev.ghsCodes").alias("a")).where("a is not null and b is not null")
    out = p.select("id", "load_no", F.array_sort(F.array_except("b", "a")).alias("added"), F.array_sort(F.array_except("a", "b")).alias("removed")).where("size(added) > 0 or size(removed) > 0")
    return out.groupBy("id", "added", "removed").agg(F.min("load_no").alias("load_no"))


_REQ = ", ".join(f"('{h}', '{g}')" for g, hs in text.REQUIRED.items() for h in hs.split())


@query(f"""with m(h, g) as (values {_REQ}),
  c as (select distinct row_no, unnest(regexp_extract_all(array_to_string(hazardStatements, ' '), 'H[0-9]{{3}}')) as h from msds_sample),
  f as (select row_no, bool_or(g = 'GHS06') as skull, bool_or(g = 'GHS05') as corr, bool_or(c.h = 'H334') as resp from c left join m using (h) group by row_no),
  n as (select c.row_no, m.g from c join m using (h) join f using (row_no) where not (m.g = 'GHS07' and (coalesce(skull, false) or (coalesce(corr, false) and c.h in ('H315', 'H319')) or (resp and c.h in ('H315', 'H317', 'H319')))))
  select row_no, string_agg(distinct g, ',' order by g) as needed from n group by row_no""")
def rul6_required_pictograms(spark: SparkSession, d: str) -> DataFrame:
    h = F.array_distinct(F.regexp_extract_all(F.array_join("hazardStatements", " "), F.lit("H[0-9]{3}"), F.lit(0)))
    return table(spark, d, "msds_sample").select("row_no", F.array_join(text.required_pictograms(h), ",").alias("needed")).where("needed <> ''")


_PRECAUTION_LISTS = ("prevention", "response", "storage", "disposal")
_RUL8_ALL = " union all ".join(f"select '{p}' as list, unnest(precautionaryStatements.{p}) as s from msds_sample" for p in _PRECAUTION_LISTS)


@query(f"""select list, grp, count(*) as n from (select list, case substr(regexp_extract(s, 'P[0-9]{{3}}'), 2, 1) when '1' then 'prevention' when '2' then 'prevention' when '3' then 'response' when '4' then 'storage' when '5' then 'disposal' else 'none' end as grp
  from ({_RUL8_ALL}) where s is not null) group by list, grp""")
def rul8_precaution_groups(spark: SparkSession, d: str) -> DataFrame:
    """Statements of all four lists by the group that the first digit of their code stands for."""
    parts = F.array(*[F.struct(F.lit(p).alias("list"), F.col(f"precautionaryStatements.{p}").alias("xs")) for p in _PRECAUTION_LISTS])
    s = table(spark, d, "msds_sample").select(F.explode(parts).alias("p")).select("p.list", F.explode("p.xs").alias("s")).where("s is not null")
    digit = F.substring(F.regexp_extract("s", "P[0-9]{3}", 0), 2, 1)
    grp = F.when(digit.isin("1", "2"), "prevention").when(digit == "3", "response").when(digit == "4", "storage").when(digit == "5", "disposal").otherwise("none")
    return s.groupBy("list", grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("""select s.row_no, case when p.k is not null then p.after else s.signalWord end as signalWord, p.k is not null as patched from msds_sample s
  left join (select productId as k, max(signalWordCandidate) as after from msds_overrides where productId is not null group by 1) p on p.k = s.id and s.signalWord is not distinct from ''""")
def mrg7_guarded_patch(spark: SparkSession, d: str) -> DataFrame:
    patches = table(spark, d, "msds_overrides").where("productId is not null").groupBy(F.col("productId").alias("key")).agg(F.max("signalWordCandidate").alias("after")).withColumn("before", F.lit(""))
    return op.guarded_patch(table(spark, d, "msds_sample").select("row_no", "id", "signalWord"), "id", "signalWord", patches).select("row_no", "signalWord", "patched")


@query(r"""select row_no, v as cell from (select row_no, case when regexp_matches(w, '[",\r\n]') then '"' || replace(w, '"', '""') || '"' else w end as v
  from (select row_no, case when regexp_matches(x, '^[=+\-@\t\r]') then '''' || x else x end as w from (select row_no, coalesce(emergencyContact, '') as x from msds_sample)))""")
def snk1_csv_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "msds_sample").select("row_no", text.csv_cell(F.col("emergencyContact")).alias("cell"))
