"""Queries of this subpackage over a catalogue folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialworks.llm import bpe, names, packing, pieces, scans, survivor, truncation
from vialworks.operators.timestamps import normalise_timestamps
from vialworks.session import checkpoint
from vialworks.sources.tables import table

CAPACITY = 2048
LIMIT, OVERLAP = 512, 64


def _fields() -> dict:
    return {"hazardStatements": F.col("hazardStatements"), "prevention": F.col("precautionaryStatements.prevention")}


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "msds_sample"), "row_no", "dataSource", _fields())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("row_no", "field_name", "item_no")


def p2_source_rates(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("f"), F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)).alias("n")) for f, c in _fields().items()]
    totals = table(spark, d, "msds_sample").select("dataSource", F.explode(F.array(*parts)).alias("p")).groupBy("dataSource", F.col("p.f").alias("field_name")).agg(F.sum(F.greatest("p.n", F.lit(0))).alias("n_items"))
    return truncation.source_rates(_cut(spark, d), totals, "dataSource")


def p2_hazards(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("f"), F.transform(c, F.length).alias("n")) for f, c in _fields().items()]
    lengths = table(spark, d, "msds_sample").select("dataSource", F.explode(F.array(*parts)).alias("p")).select("dataSource", F.col("p.f").alias("field_name"), F.explode("p.n").alias("length"))
    return truncation.length_hazards(lengths, ["dataSource", "field_name"], "length")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_damaged(table(spark, d, "msds_sample"), "row_no", _fields())


def p7_statements(spark: SparkSession, d: str) -> DataFrame:
    return scans.clean_statements(table(spark, d, "msds_sample"), "row_no", _fields())


def _companies(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "msds_sample").select(F.col("supplier").alias("name"), "id").unionByName(table(spark, d, "msds_overrides").select(F.col("supplierCandidate").alias("name"), F.col("productId").alias("id")))
    return names.link_names(both, "name", witness="id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_companies(spark, d))


def p3_companies(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its company and the number of the company's spellings."""
    linked = _companies(spark, d)
    return linked.join(linked.groupBy("company").agg(F.count(F.lit(1)).alias("spellings")), "company").select("name", "company", "spellings")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "data_source")
    rows = table(spark, d, "msds_sample").select("row_no", "id", "dataSource", "revisionDate", "productName", "fileName", "pdfPath", "loaded_at")
    dated = normalise_timestamps(rows, "revisionDate", "dataSource", sources, "loaded_at").join(sources.select("dataSource", "trust_rank"), "dataSource", "left")
    named = ~survivor.stand_in(F.col("productName")) & ~survivor.lost_end(F.col("productName"), F.col("fileName"))
    filed = ~survivor.stand_in(F.col("pdfPath")) & survivor.finished_pdf(F.col("pdfPath"))
    return dated.select("row_no", "id", "utc_us", "trust_rank", "revisionDate", F.when(named, F.col("productName")).alias("productName"), F.when(filed, F.col("pdfPath")).alias("pdfPath"))


def _merged_fields() -> dict[str, survivor.Field]:
    trust, at, first = -F.coalesce("trust_rank", F.lit(1 << 30)), F.col("utc_us"), -F.col("row_no")
    return {
        "revisionDate": survivor.Field(F.col("revisionDate"), at.isNotNull(), (), at, (trust, first)),
        "productName": survivor.Field(F.col("productName"), F.col("productName").isNotNull(), (trust,), at, (first,)),
        "pdfPath": survivor.Field(F.col("pdfPath"), F.col("pdfPath").isNotNull(), (trust,), at, (first,)),
    }


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The merge with the order that TESTDATA.md fixes; among product names of equal trust, the learned precedence puts
    names without a time behind those that follow them elsewhere."""
    rows, fields = checkpoint(_deliveries(spark, d)), _merged_fields()  # read several times
    learned = survivor.precedence(rows.where(fields["productName"].usable), "id", "productName", "utc_us")
    return survivor.survivors(rows, "id", "row_no", fields, {"productName": survivor.sure_order(learned)})


def p6_fixed_order(spark: SparkSession, d: str) -> DataFrame:
    """The same without learned precedence: a missing time is the earliest, whatever the value."""
    return survivor.survivors(_deliveries(spark, d), "id", "row_no", _merged_fields())


def p6_current_names(spark: SparkSession, d: str) -> DataFrame:
    """The most current usable product name of each entry, by times and by learned precedence of names."""
    rows = checkpoint(_deliveries(spark, d).where("productName is not null").select("id", "productName", "utc_us"))  # read several times
    learned = survivor.precedence(rows, "id", "productName", "utc_us")
    return survivor.latest_values(rows, "id", "productName", "utc_us", learned)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", bpe.vocabulary())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text", bpe.vocabulary())
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: containers, tokens, the fewest possible, and the share used."""
    used = p9_containers(spark, d).agg(F.max("container_no").alias("containers"), F.sum("part_size").alias("tokens"))
    return used.select("containers", "tokens", F.ceil(F.col("tokens") / CAPACITY).alias("least"), F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("share"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "documents"), "doc_id", "text", bpe.vocabulary(), LIMIT, OVERLAP, only_oversized=True)


QUERIES = {f.__name__: f for f in (p2_found, p2_source_rates, p2_hazards, p3_found, p3_companies, p6_found, p6_fixed_order, p6_current_names, p7_found, p7_statements, p8_ids, p9_containers, p9_fill, p10_pieces)}
ORACLES: dict[str, str] = {}
