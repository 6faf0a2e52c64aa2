"""Texts cut off by field limits or mid-transfer, and how often each source cuts.

Method: discrete length hazards. For every source and field the share of texts of length L among those of at least L
is computed by window functions and tested against the hazards of the neighbouring lengths; the lengths that stay
significant under Benjamini-Hochberg control over all groups are field limits. An ending is judged by the corpus' own
sentences: whether they end where the text does. At significant lengths an ending that isn't certain to be complete is
a case; elsewhere, where a transfer may have been cut at any place, it is enough that sentences mostly end so.

Defined results: null and empty items are no case. An omission mark, or a broken character, at the end is one. Heads
and feet of pages are none, nor is an item whose statement goes on in the next item. Items are judged alone, so
repeated rows give repeated cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vialworks.llm.scans import reassemble, without_pages
from vialworks.llm.statements import HEAD, MORE, Labeller, Model, Reader, rows_of_lists, sentences, train
from vialworks.session import checkpoint


def length_hazards(lengths: DataFrame, by: list[str], length: str, reach: int = 5, level: float = 0.01) -> DataFrame:
    """(by..., length, n, at_risk, hazard, around, p_value, significant): one row per length that occurs.

    around: the hazard of the lengths within `reach`, pooled. The test is one-sided binomial in its normal
    approximation; level: the false-discovery rate over the tests of all groups together (Benjamini and Hochberg). Null
    lengths are left out. The windows run over counts, one row a group and length, never over texts.
    """
    h = checkpoint(lengths.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*by).orderBy(F.desc("length"))  # one row a length
    near = Window.partitionBy(*by).orderBy("length").rangeBetween(-reach, reach)
    h = h.withColumn("at_risk", F.sum("n").over(w))
    pooled = (F.sum("n").over(near) - F.col("n")) / F.greatest(F.sum("at_risk").over(near) - F.col("at_risk"), F.lit(1))
    h = h.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("around", F.greatest(pooled, 1 / F.col("at_risk")))
    z = (F.col("n") - F.col("at_risk") * F.col("around") - 0.5) / F.sqrt(F.greatest(F.col("at_risk") * F.col("around") * (1 - F.least("around", F.lit(0.999))), F.lit(1e-9)))
    # upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    h = h.withColumn("p_value", F.when(z >= 0, tail).otherwise(1 - tail))
    # the largest rank k of all m tests whose p-value is within level * k / m; equal p-values share their last rank
    ranks = h.groupBy("p_value").agg(F.count(F.lit(1)).alias("c"))
    ranks = ranks.select("p_value", F.sum("c").over(Window.orderBy("p_value")).alias("k"), F.sum("c").over(Window.partitionBy()).alias("m"))
    passed = ranks.where(F.col("p_value") <= level * F.col("k") / F.col("m")).agg(F.max("p_value").alias("__cut"))
    return h.join(F.broadcast(passed)).withColumn("significant", F.coalesce(F.col("p_value") <= F.col("__cut"), F.lit(False))).drop("__cut")


def find_truncated(df: DataFrame, key: str, source: str, fields: dict[str, Column], level: float = 0.01, sample: int = 2_000, trained: tuple[Model, Labeller] | None = None) -> DataFrame:
    """(key, field_name, item_no, source, length, marked, significant, reason): every item whose end is missing.

    reason: `limit` for an incomplete ending at a significant length, where an ending must be certain to pass; `transfer`
    for one at any other length, where it is enough that the corpus' sentences mostly end so. trained: a model of the
    same statements that `train` has made already.
    """
    model, labeller = trained or train(df, key, fields, sample)
    shared = df.sparkSession.sparkContext.broadcast((model, labeller))  # bounded by the model's shares
    names = list(fields)

    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("item_no", T.IntegerType()), T.StructField(source, df.schema[source].dataType),
         T.StructField("length", T.IntegerType()), T.StructField("marked", T.BooleanType()), T.StructField("__ended", T.BooleanType())]
    )
    arrow = to_arrow_schema(schema)

    def cut(xs: list[str | None], reader: Reader) -> Iterator[tuple[int, int, bool, bool]]:
        """(item, length, marked, ended) of the items whose end isn't beyond doubt."""
        numbers, texts, lines, labels = reader.read(xs)
        tail: tuple[str, ...] = ()
        for i, (no, line, (y, bad)) in enumerate(zip(numbers, lines, labels, strict=True)):
            if y == HEAD:
                continue
            tail = tail + line.fixed if y == MORE else line.fixed
            if line.sure or (y == MORE and not line.marked and reader.model.complete(sentences(list(tail))[-1], certain=0.9)):
                continue
            if bad and (bare := without_pages(texts[i], reader)) != texts[i] and bare:  # page text may stand at the end
                line = reader.lines([bare])[2][-1]
                if line.sure:
                    continue
            if i and numbers[i - 1] == no:  # a statement over several lines is judged as a whole
                whole = reassemble([xs[no - 1]], reader)
                line = reader.lines(whole[-1:])[2][-1] if whole else line
                if line.sure:
                    continue
            j = i + 1
            while j < len(lines) and labels[j][0] == HEAD:
                j += 1
            if j < len(lines) and (numbers[j] == no or labels[j][0] == MORE):
                continue
            yield no, len(xs[no - 1]), line.marked, line.ended

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            keys, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(keys[r], names[c - 2], no, sources[r], *x) for c, r, xs in rows_of_lists(batch, 2) for no, *x in cut(xs, reader)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], t.type) for t in arrow], schema=arrow)

    open_ones = df.select(F.col(key).alias("__key"), F.col(source).alias("__src"), *[c.alias(f) for f, c in fields.items()]).mapInArrow(judge, schema)
    parts = [F.struct(F.lit(f).alias("f"), F.transform(c, F.length).alias("n")) for f, c in fields.items()]
    lengths = df.select(F.col(source), F.explode(F.array(*parts)).alias("p")).select(source, F.col("p.f").alias("field_name"), F.explode("p.n").alias("length"))
    peaks = length_hazards(lengths, [source, "field_name"], "length", level=level).where("significant").select(source, "field_name", "length", "significant")
    found = open_ones.join(peaks, [source, "field_name", "length"], "left").withColumn("significant", F.coalesce("significant", F.lit(False)))
    return found.where(~F.col("__ended") | F.col("significant")).select(key, "field_name", "item_no", source, "length", "marked", "significant", F.when(F.col("significant"), "limit").otherwise("transfer").alias("reason"))


def source_rates(found: DataFrame, totals: DataFrame, source: str) -> DataFrame:
    """(source, field_name, n_items, n_cut, share, at_limits): how often each source cuts. totals: (source, field_name, n_items)."""
    cut = found.groupBy(source, "field_name").agg(F.count(F.lit(1)).alias("n_cut"), F.sum(F.col("significant").cast("long")).alias("at_limits"))
    n = F.coalesce("n_cut", F.lit(0))
    return totals.join(cut, [source, "field_name"], "left").select(source, "field_name", "n_items", n.alias("n_cut"), F.round(n / F.col("n_items"), 6).alias("share"), F.coalesce("at_limits", F.lit(0)).alias("at_limits"))
