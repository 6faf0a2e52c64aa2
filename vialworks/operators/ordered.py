"""Neighbours in an order, without one task per group.

A window over a group puts the group into one task. Here rows are partitioned by range over the whole order, so a
group that holds most rows is spread over many tasks; only the first and last row of every task are looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialworks.session import checkpoint


def previous(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """`df` with `prev`, a struct of `columns` of the row before in the order of its group; null for a group's first.

    The order must end in something unique within the group. Nulls come first; a null group is a group.
    """
    at = [*group, *order]
    placed = checkpoint(df.repartitionByRange(*at).withColumn("__p", F.spark_partition_id()))
    here = F.struct(F.struct(*group).alias("g"), F.struct(*columns).alias("c"))
    w = Window.partitionBy("__p").orderBy(*at)
    lagged = placed.withColumn("__lag", F.lag(here).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    # at most one row a task: the last rows of the tasks before
    ends = placed.groupBy("__p").agg(F.max(F.struct(F.struct(*at).alias("at"), here.alias("h"))).alias("m"))
    ends = ends.select(F.lead("__p").over(Window.orderBy("__p")).alias("__q"), F.col("m.h").alias("__end"))
    j = lagged.join(F.broadcast(ends), (F.col("__p") == F.col("__q")) & F.col("__first"), "left").withColumn("__lag", F.coalesce("__lag", "__end"))
    return j.withColumn("prev", F.when(F.col("__lag.g").eqNullSafe(F.struct(*group)), F.col("__lag.c"))).select(*[F.col(f"`{c}`") for c in df.columns], "prev")
