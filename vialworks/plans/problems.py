"""Queries of the general data problems (1, 4, 5) over a catalogue folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.operators import profile, segmentation
from vialworks.operators.timestamps import estimate_zones, normalise_timestamps, read_local, to_utc_us
from vialworks.sources.tables import table

#: The forms of TESTDATA.md, problem 5.
FORMS = {
    "msdsNo": r"^[A-Z]{2}[0-9]{5}-[0-9]{10}$",
    "revisionDate": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "emergencyContact": r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}",
}


def revision_instants(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, record_no, utc_us) of both tables, null where the text holds no full date."""
    zones = table(spark, d, "data_source")
    a = normalise_timestamps(table(spark, d, "msds_sample").select("row_no", "dataSource", "revisionDate", "loaded_at"), "revisionDate", "dataSource", zones, "loaded_at")
    b = normalise_timestamps(table(spark, d, "msds_overrides").select("override_no", "dataSource", "revisionDateCandidate", "reviewedAt"), "revisionDateCandidate", "dataSource", zones, "reviewedAt")
    return a.select(F.lit("msds_sample").alias("table_name"), F.col("row_no").alias("record_no"), "utc_us").unionByName(
        b.select(F.lit("msds_overrides").alias("table_name"), F.col("override_no").alias("record_no"), "utc_us")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return revision_instants(spark, d).where("utc_us is not null")


def p1_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The zone that each source would get if its own were withheld, from arrival times and from the order of deliveries
    of an entry, beside the given one. Values that name a zone aren't local times; as neighbours their instants count."""
    zones = table(spark, d, "data_source")
    rows = read_local(table(spark, d, "msds_sample").select("row_no", "id", "load_no", "dataSource", "revisionDate", "loaded_at"), "revisionDate", "dataSource", zones)
    named = F.coalesce("__read.zone", "__zone")
    rows = rows.select(
        "row_no", "id", "load_no", "dataSource", F.when(F.col("__read.zone").isNull(), F.col("__read.local_us")).alias("local_us"),
        to_utc_us(F.col("__read.local_us"), named).alias("known_us"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at_us"),
    )
    found = estimate_zones(rows, "dataSource", "local_us", "at_us", None, "known_us", (["id"], ["load_no", "row_no"]))
    return found.join(zones.select("dataSource", F.col("zone_id").alias("given_zone")), "dataSource", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.split_values(table(spark, d, "msds_sample"), "row_no", ["emergencyContact", "ppeSummary"])


def _masks(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_counts(table(spark, d, "msds_sample"), "load_no", list(FORMS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    figures = profile.load_figures(_masks(spark, d), {k: profile.mask_form(v) for k, v in FORMS.items()})
    return profile.changed_figures(figures)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_figures(_masks(spark, d), {k: profile.mask_form(v) for k, v in FORMS.items()}).select(
        "load_no", "field_name", "n_rows", "n_blank", *(F.round(c, 6).alias(c) for c in ("blank", "distinct", "pattern", "length"))
    )


def p5_masks(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_report(_masks(spark, d))


def p5_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_divergence(_masks(spark, d))


_P5 = """
with v as (
  select load_no, 'msdsNo' as field_name, msdsNo as v, regexp_full_match(coalesce(msdsNo, ''), '[A-Z]{2}[0-9]{5}-[0-9]{10}') as fits from msds_sample
  union all select load_no, 'revisionDate', revisionDate, regexp_matches(coalesce(revisionDate, ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') from msds_sample
  union all select load_no, 'emergencyContact', emergencyContact, regexp_matches(coalesce(emergencyContact, ''), '[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}') from msds_sample),
b as (select *, coalesce(trim(v, ' \t\n'), '') = '' as is_blank from v),
f as (
  select load_no, field_name, count(*) as n_rows, cast(count(*) filter (is_blank) as bigint) as n_blank,
    (count(*) filter (is_blank))::double / count(*) as blank,
    (count(distinct v) filter (not is_blank))::double / nullif(count(*) filter (not is_blank), 0) as "distinct",
    (count(*) filter (not is_blank and not fits))::double / nullif(count(*) filter (not is_blank), 0) as pattern,
    (sum(length(v)) filter (not is_blank))::double / nullif(count(*) filter (not is_blank), 0) as length
  from b group by all)
"""

ORACLES = {
    "p5_profile": _P5 + 'select load_no, field_name, n_rows, n_blank, round(blank, 6) as blank, round("distinct", 6) as "distinct", round(pattern, 6) as pattern, round(length, 6) as length from f',
    "p5_found": _P5
    + """, g as (select *, lag(blank) over w as pb, lag("distinct") over w as pd, lag(pattern) over w as pp, lag(length) over w as pl
       from f where load_no is not null window w as (partition by field_name order by load_no))
    select load_no, field_name, 'blank' as figure from g where abs(blank - pb) > 0.12
    union all select load_no, field_name, 'distinct' from g where abs("distinct" - pd) > 0.12
    union all select load_no, field_name, 'pattern' from g where abs(pattern - pp) > 0.12
    union all select load_no, field_name, 'length' from g where abs(length - pl) > 0.25 * pl""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_zone_estimates, p4_found, p5_found, p5_profile, p5_masks, p5_divergence)}
