"""Queries that read records from document texts, and SQL where a text's lines can be read with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vialworks.functions import text as tx
from vialworks.operators import sheets
from vialworks.plans.catalogue import _CAS, query
from vialworks.sources.tables import table


def _records(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    return sheets.records(table(spark, d, "documents"), "doc_id", "text", list(wanted))


_LINE = "(select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as l from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))"
_HEAD = {n: rf"(?i)^\s*(?:#+\s*|\[)?(?:제\s*)?(?:section\s*)?{n}(?:\s*(?:[\].．:\-–]|항)\s*|\s+)[.．:\-–]?\s*(?:{t})" for n, t in sheets.TITLES.items()}


@query(f"""select doc_id, section, count(*) as lines, cast(sum(length(l)) as bigint) as chars from (select doc_id, l, last_value(h ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as section
  from (select doc_id, pos, l, case {" ".join(f"when regexp_matches(l, '{p}') then {n}" for n, p in _HEAD.items())} end as h from {_LINE})) where section is not null group by all""")
def ext1_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of every section. A window holds the lines of one document."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    h = F.coalesce(*[F.when(F.col("l").rlike(p), F.lit(n)) for n, p in _HEAD.items()])
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("section", F.last(h, ignorenulls=True).over(w)).where("section is not null")
    return s.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("l")).alias("chars"))


@query(f"""select doc_id, pos, m[2] || '. ' || trim(m[1]) as repaired from (select doc_id, pos, [regexp_extract(trim(l), '^([^0-9]{{2,40}}?)\\s*([0-9]{{1,2}})\\s*[.．]\\s*$', 1), regexp_extract(trim(l), '^([^0-9]{{2,40}}?)\\s*([0-9]{{1,2}})\\s*[.．]\\s*$', 2)] as m from {_LINE}) where m[2] <> ''""")
def ext2_slipped_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose number stands behind their words, with it in front."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    pattern = r"^([^0-9]{2,40}?)\s*([0-9]{1,2})\s*[.．]\s*$"
    n = F.regexp_extract(F.trim("l"), pattern, 2)
    return lines.where(n != "").select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.concat(n, F.lit(". "), F.trim(F.regexp_extract(F.trim("l"), pattern, 1))).alias("repaired"))


@query(f"""select doc_id, pos, case when v <> '' then v else coalesce(nxt, '') end as value from (select doc_id, pos, trim(regexp_replace(l, '^.*?(?:개정일자|개정일|Rev\\.)[\\s:：>\\-]*', '')) as v, trim(nxt) as nxt, row_number() over (partition by doc_id order by pos) as r
  from (select *, lead(l) over (partition by doc_id order by pos) as nxt from {_LINE}) where regexp_matches(l, '개정일자|개정일|Rev\\.')) where r = 1""")
def ext3_first_value(spark: SparkSession, d: str) -> DataFrame:
    """What stands behind the first label of a revision, or on the line after it."""
    ls = F.split("text", "\n")
    hit = F.get(F.filter(F.transform(ls, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("l"))), lambda x: x.l.rlike(r"개정일자|개정일|Rev\.")), F.lit(0))
    s = table(spark, d, "documents").where("text is not null").select("doc_id", hit.alias("h"), ls.alias("ls")).where("h is not null")
    v = F.trim(F.regexp_replace("h.l", r"^.*?(?:개정일자|개정일|Rev\.)[\s:：>\-]*", ""))
    return s.select("doc_id", F.col("h.pos").cast("bigint").alias("pos"), F.when(v != "", v).otherwise(F.coalesce(F.trim(F.get("ls", F.col("h.pos"))), F.lit(""))).alias("value"))


@query(f"""select doc_id, pos, cas, regexp_extract(l, '[0-9]+(?:\\.[0-9]+)?\\s*%') as content from (select doc_id, pos, l, unnest(string_split_regex(l, '[^0-9A-Za-z_-]+')) as cas from {_LINE}) where {_CAS.format(c='cas')}""")
def ext5_ingredient_lines(spark: SparkSession, d: str) -> DataFrame:
    """Registry numbers in the lines of every document, with the first percentage of the line."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).where(F.col("l").rlike("[0-9]-[0-9]{2}-[0-9]"))
    return lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.explode(tx.extract_cas(F.col("l"))).alias("cas"), F.regexp_extract("l", r"[0-9]+(?:\.[0-9]+)?\s*%", 0).alias("content"))


@query(f"""select doc_id, count(*) as coded, count(*) filter (regexp_matches(l, 'P[0-9]{{3}}')) as with_precaution from {_LINE} where regexp_matches(l, 'H[0-9]{{3}}') group by doc_id""")
def ext9_coded_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike("H[0-9]{3}"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("coded"), F.count_if(F.col("l").rlike("P[0-9]{3}")).alias("with_precaution"))


@query()
def ext4_basic_info(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "product", "supplier", "number", "phone", "revised", "issued").select("doc_id", "product", "supplier", "number", "phone", "revised", "issued")


@query()
def ext6_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "ingredients").select("doc_id", F.posexplode("ingredients").alias("pos", "x")).select("doc_id", "pos", "x.*")


@query()
def ext7_components(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "components").select("doc_id", F.posexplode("components").alias("pos", "x")).select("doc_id", "pos", "x.*")


@query()
def ext8_statements(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "statements", "precautions")
    return r.select("doc_id", F.explode(F.concat(F.col("statements"), *[F.col(f"precautions.{g}") for g in sheets.GROUPS])).alias("statement"))


@query()
def ext10_precautions(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "by_label").select("doc_id", F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"by_label.{g}").alias("xs")) for g in sheets.GROUPS])).alias("p"))
    return r.select("doc_id", "p.grp", F.explode("p.xs").alias("line"))


@query()
def ext11_section_two(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "sections", "signal", "hazards", "unclassified", "candidates").where("array_contains(sections, 2)").select("doc_id", "signal", "hazards", "unclassified", "candidates")


@query()
def ext12_legal_flags(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "flags").select("doc_id", F.explode("flags").alias("x")).select("doc_id", "x.*")


@query()
def ext13_first_aid(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "aid").select("doc_id", F.explode("aid").alias("x")).select("doc_id", "x.*")


@query()
def ext14_classification(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "sections", "classification").where("array_contains(sections, 2)").select("doc_id", "classification")


@query()
def ext15_signal_words(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "signal", "signal_rule").where("signal <> ''").select("doc_id", "signal", "signal_rule")


@query()
def ext16_equipment_lines(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "equipment").select("doc_id", F.explode("equipment").alias("line"))


@query()
def ext17_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "address").where("address <> ''").select("doc_id", "address")


@query()
def ext18_cas_names(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "cas_names").select("doc_id", F.explode("cas_names").alias("x")).select("doc_id", "x.*")


@query()
def ext19_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole record of every document; failed ones are empty and marked."""
    return _records(spark, d)


@query()
def rul4_label_pictograms(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "pictograms").where("pictograms is not null").select("doc_id", "pictograms")


@query()
def scl9_document_dates(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "revised", "issued").select("doc_id", "revised", "issued")


@query()
def src6_text_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document has a text, and its sections."""
    return _records(spark, d, "status", "sections").select("doc_id", "status", F.size("sections").alias("sections"))
