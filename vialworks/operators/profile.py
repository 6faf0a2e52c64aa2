"""Column-level quality profile, load by load.

Method: every value is generalised to its character-class mask (upper case A, lower case a, digit 9, Hangul 가, other
letters x; runs keep their length). The table is reduced to counts of (load, field, mask) and (load, field, value)
with partial aggregation before any shuffle, and all figures come from those counts: a required form is tested on
the masks, dominant masks are those that cover `dominant` of a load's values, and loads are compared by the
Jensen-Shannon divergence of their mask distributions.

Defined results: a value is blank if null, empty or only spaces. A field that is blank throughout a load has no
distinct, pattern and length figures there, and no case. Empty tables give empty results. Loads are compared with the
next lower load number present in the table; the first load has no case. Null load numbers count as a load of their
own and are compared with nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mask(value: Column) -> Column:
    """The character-class mask of a text, of the text's length."""
    m = F.regexp_replace(value, "[a-z]", "a")
    m = F.regexp_replace(m, "[A-Z]", "A")
    m = F.regexp_replace(m, "[0-9]", "9")
    m = F.regexp_replace(m, "[가-힣]", "가")
    return F.regexp_replace(m, r"[\p{L}&&[^Aa가]]", "x")


def mask_form(form: str) -> str:
    """A form over the classes [A-Z], [a-z] and [0-9] as the same form over masks."""
    return form.replace("[A-Z]", "A").replace("[a-z]", "a").replace("[0-9]", "9")


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^[\s　 ]*$")


def mask_counts(df: DataFrame, load: str, fields: list[str]) -> DataFrame:
    """(load_no, field_name, mask, n, chars, distincts): one row per mask; mask null: the blank values.

    Two aggregations: by value (partial before the shuffle, so a hot value is one row a task), then by mask.
    """
    parts = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v")) for f in fields]
    long = df.select(F.col(load).alias("load_no"), F.explode(F.array(*parts)).alias("p")).select("load_no", "p.field_name", F.when(~blank(F.col("p.v")), F.col("p.v")).alias("v"))
    values = long.groupBy("load_no", "field_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return (
        values.groupBy("load_no", "field_name", mask(F.col("v")).alias("mask"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.length("v")).alias("chars"), F.count("v").alias("distincts"))
    )


def load_figures(counts: DataFrame, forms: dict[str, str]) -> DataFrame:
    """(load_no, field_name, n_rows, n_blank, blank, distinct, pattern, length), one row per load and field.

    forms: field -> regular expression over masks; a field without one has no pattern figure.
    """
    fits = reduce(lambda a, kv: F.when(F.col("field_name") == kv[0], F.col("mask").rlike(kv[1])).otherwise(a), forms.items(), F.lit(None).cast("boolean"))
    full = F.col("mask").isNotNull()
    g = counts.groupBy("load_no", "field_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("n_blank"),
        F.sum(F.when(full, F.col("n"))).alias("n_full"),
        F.sum(F.when(full, F.col("distincts"))).alias("n_distinct"),
        F.sum(F.when(full & ~fits, F.col("n"))).alias("n_off"),
        F.sum(F.when(full & fits, F.col("n"))).alias("n_fit"),
        F.sum("chars").alias("chars"),
    )
    has_form = F.col("n_off").isNotNull() | F.col("n_fit").isNotNull()
    return g.select(
        "load_no", "field_name", "n_rows", "n_blank",
        (F.col("n_blank") / F.col("n_rows")).alias("blank"),
        (F.col("n_distinct") / F.col("n_full")).alias("distinct"),
        F.when(has_form, F.coalesce("n_off", F.lit(0)) / F.col("n_full")).alias("pattern"),
        (F.col("chars") / F.col("n_full")).alias("length"),
    )


def changed_figures(figures: DataFrame, threshold: float = 0.12, length_share: float = 0.25) -> DataFrame:
    """(load_no, field_name, figure): the figures that differ from those of the next lower load."""
    w = Window.partitionBy("field_name").orderBy("load_no")  # one row a load and field
    names = ("blank", "distinct", "pattern", "length")
    now = figures.where("load_no is not null").select("load_no", "field_name", *names, *(F.lag(n).over(w).alias(f"_{n}") for n in names))
    cases = [F.when(F.abs(F.col(n) - F.col(f"_{n}")) > (F.lit(threshold) if n != "length" else length_share * F.col("_length")), F.lit(n)) for n in names]
    return now.select("load_no", "field_name", F.explode(F.array_compact(F.array(*cases))).alias("figure"))


def mask_report(counts: DataFrame, dominant: float = 0.9, rare: float = 0.01) -> DataFrame:
    """Masks of each load and field with their share, whether they are dominant, and whether they violate as rare.

    Dominant masks are the most frequent ones that together cover `dominant` of the values; a mask under `rare` that
    isn't dominant is a violation.
    """
    w = Window.partitionBy("load_no", "field_name")
    order = w.orderBy(F.desc("n"), "mask").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.where("mask is not null")
        .withColumns({"share": F.col("n") / F.sum("n").over(w), "before": F.coalesce(F.sum("n").over(order), F.lit(0)) / F.sum("n").over(w)})
        .select("load_no", "field_name", "mask", "n", "share", (F.col("before") < dominant).alias("is_dominant"), ((F.col("before") >= dominant) & (F.col("share") < rare)).alias("is_violation"))
    )


def mask_divergence(counts: DataFrame) -> DataFrame:
    """(load_no, field_name, previous_load, divergence): Jensen-Shannon divergence, base 2, of the masks of a load and
    of the load before it."""
    c = counts.where("mask is not null and load_no is not null").select("load_no", "field_name", "mask", "n")
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("load_no", "field_name"))).drop("n")
    loads = c.select("field_name", "load_no").distinct()
    pairs = loads.withColumn("previous_load", F.lag("load_no").over(Window.partitionBy("field_name").orderBy("load_no"))).where("previous_load is not null")
    now = pairs.join(p, ["field_name", "load_no"]).select("field_name", "load_no", "previous_load", "mask", "p", F.lit(0.0).alias("q"))
    then = pairs.join(p.withColumnRenamed("load_no", "previous_load"), ["field_name", "previous_load"]).select("field_name", "load_no", "previous_load", "mask", F.lit(0.0).alias("p"), F.col("p").alias("q"))
    both = now.unionByName(then).groupBy("field_name", "load_no", "previous_load", "mask").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0) / 2
    return both.groupBy("load_no", "field_name", "previous_load").agg(F.round(F.sum(part("p") + part("q")), 9).alias("divergence"))
