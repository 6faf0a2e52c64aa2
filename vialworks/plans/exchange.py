"""Queries of sources, sinks and upkeep over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.plans.catalogue import query
from vialworks.plans.relations import _LIVE, _live, _register
from vialworks.sinks.files import csv_line
from vialworks.sources import files
from vialworks.sources.tables import table
from vialworks.streaming import upkeep

_CELL = lambda c: f"(case when regexp_matches(y, '[\",\\r\\n]') then '\"' || replace(y, '\"', '\"\"') || '\"' else y end)".replace("y", f"(case when regexp_matches(coalesce({c}, ''), '^[=+\\-@\\t\\r]') then '''' || {c} else coalesce({c}, '') end)")
_CSV = lambda *cs: " || ',' || ".join(_CELL(c) for c in cs)


@query(f"select row_no, {_CSV('productName', 'supplier', 'emergencyContact', 'cast(load_no as varchar)')} as line from msds_sample")
def snk1_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "msds_sample").select("row_no", csv_line(c("productName"), c("supplier"), c("emergencyContact"), c("load_no")).alias("line"))


@query(f"with {_LIVE} select {_CSV('productName', 'supplier', 'id')} as line from live")
def snk4_product_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of entries by name, as CSV lines."""
    c = F.col
    return _live(spark, d).orderBy(F.coalesce("productName", F.lit("")), "id").select(csv_line(c("productName"), c("supplier"), c("id")).alias("line"))


@query(f"with reg as (select old as id, first(id order by row_no) as replacedBy from (select row_no, id, unnest(formerIds) as old from msds_sample) group by old) select {_CSV('id', 'replacedBy')} as line from reg")
def snk6_register_lines(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d).orderBy("id").select(csv_line(F.col("id"), F.col("replacedBy")).alias("line"))


@query("select inventory_no, fileName from pdf_inventory where not regexp_matches(relativePath, '(^|/)(?:\\.git|node_modules|__pycache__|_archive[^/]*|_backup[^/]*)(/|$)')")
def src8_listing(spark: SparkSession, d: str) -> DataFrame:
    """The listing without folders of tools and archives."""
    return table(spark, d, "pdf_inventory").where(~F.col("relativePath").rlike(files.SKIPPED)).select("inventory_no", "fileName")


@query("""with r as (select distinct 'pdf/' || relativePath as old, 'pdf/new/' || fileName as new from pdf_inventory where relativePath <> '' and fileName <> '') select distinct unnest([old, substr(old, 5), '/' || old]) as old, unnest([new, substr(new, 5), '/' || new]) as new from r""")
def src10_renames(spark: SparkSession, d: str) -> DataFrame:
    """A map of renames in its three spellings."""
    r = table(spark, d, "pdf_inventory").where("relativePath <> '' and fileName <> ''").select(F.concat(F.lit("pdf/"), "relativePath").alias("old"), F.concat(F.lit("pdf/new/"), "fileName").alias("new")).distinct()
    return files.expand_renames(r)


@query("""with s as (select row_no, item_no, min(case when item_no = 1 then productId end) as identity from msds_ingredient group by 1, 2) select row_no, item_no, sum(case when coalesce(trim(identity), '') <> '' then 1 else 0 end) over (order by row_no * 1000 + item_no) as entry from s""")
def src4_rows_to_entries(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a sheet under the entry above them: a first line of a delivery begins one."""
    i = table(spark, d, "msds_ingredient").groupBy("row_no", "item_no").agg(F.min(F.when(F.col("item_no") == 1, F.col("productId"))).alias("identity"))
    return files.rows_to_entries(i.withColumn("o", F.col("row_no") * 1000 + F.col("item_no")), "o", ["identity"]).select("row_no", "item_no", "entry")


@query("""select inventory_no from pdf_inventory p where not exists (select 1 from msds_overrides o where o.matchTarget.fileName = p.fileName and not contains(lower(o.extractStatus), 'failed'))""")
def str2_unread_files(spark: SparkSession, d: str) -> DataFrame:
    """Files to read: those without a document, and those whose reading failed."""
    o = table(spark, d, "msds_overrides").select(F.col("matchTarget.fileName").alias("fileName"), "extractStatus")
    return upkeep.unread(table(spark, d, "pdf_inventory"), o, "fileName", "contains(lower(extractStatus), 'failed')").select("inventory_no")


@query("""with q as (select relativePath as path, min(inventoryStatus) as status, min(sha256) as sha from pdf_inventory where relativePath <> '' group by 1), n as (select regexp_replace(pdfPath, '^/?pdf/', '') as path, min(sha256) as sha from pdf_inventory where pdfPath <> '' group by 1)
  select coalesce(n.path, q.path) as path, coalesce(n.sha, q.sha) as sha, q.status, case when n.path is null then 'missing' else 'present' end as state from q full join n on q.path = n.path""")
def str3_queue_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The queue of the files as the folder lists them, after a run that sees the published paths."""
    p = table(spark, d, "pdf_inventory")
    queue = p.where("relativePath <> ''").groupBy(F.col("relativePath").alias("path")).agg(F.min("inventoryStatus").alias("status"), F.min("sha256").alias("sha"))
    seen = p.where("pdfPath <> ''").groupBy(F.regexp_replace("pdfPath", "^/?pdf/", "").alias("path")).agg(F.min("sha256").alias("sha"))
    return upkeep.upsert_queue(queue, seen, "path", ["status"], "2026-01-01").select("path", "sha", "status", "state")


@query("select row_no, load_no, id, dataSource, loaded_at from msds_sample where id is not null order by loaded_at desc, row_no desc limit 100")
def str4_history(spark: SparkSession, d: str) -> DataFrame:
    """The hundred latest lines of the log of deliveries, newest first."""
    return table(spark, d, "msds_sample").where("id is not null").orderBy(F.desc("loaded_at"), F.desc("row_no")).limit(100).select("row_no", "load_no", "id", "dataSource", "loaded_at")


@query("select inventory_no, relativePath, fileName, fileSize, modifiedTime, lower(sha256) as sha256, regexp_replace(fileName, '(?i)\\.pdf$', '') as stem from pdf_inventory")
def src5_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The listing as a scan of a folder gives it; `files.list_files` makes it from files."""
    return table(spark, d, "pdf_inventory").select("inventory_no", "relativePath", "fileName", "fileSize", "modifiedTime", F.lower("sha256").alias("sha256"), F.regexp_replace("fileName", r"(?i)\.pdf$", "").alias("stem"))


@query("select doc_id, case when n_alt > n then 'second' else 'first' end as reading from (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[HP][0-9]{3}')) as n, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '([HP])\\s([0-9]{3})', '\\1\\2', 'g'), '[HP][0-9]{3}')) as n_alt from documents)")
def src7_better_reading(spark: SparkSession, d: str) -> DataFrame:
    """Of two readings of a text the one with more codes; the second closes blanks inside codes."""
    t = F.coalesce("text", F.lit(""))
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit("[HP][0-9]{3}"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.when(n(F.regexp_replace(t, r"([HP])\s([0-9]{3})", "$1$2")) > n(t), "second").otherwise("first").alias("reading"))


@query("select override_no, case when coalesce(matchTarget.fileName, '') = '' then 'missing: fileName' when coalesce(reviewStatus, '') = '' then 'missing: reviewStatus' end as problem from msds_overrides")
def src11_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a reviewed upload, with what is missing."""
    o = table(spark, d, "msds_overrides")
    e = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return o.select("override_no", F.when(e("matchTarget.fileName"), "missing: fileName").when(e("reviewStatus"), "missing: reviewStatus").alias("problem"))


@query("select id, pdfPath from (select id, pdfPath, row_number() over (partition by id order by load_no desc, row_no desc) as r from msds_sample where id is not null) where r = 1 and pdfPath <> ''")
def src9_current_files(spark: SparkSession, d: str) -> DataFrame:
    """The file that every entry maps to now."""
    s = table(spark, d, "msds_sample").where("id is not null").groupBy("id").agg(F.max(F.struct("load_no", "row_no", "pdfPath")).alias("m"))
    return s.select("id", "m.pdfPath").where("pdfPath <> ''")

