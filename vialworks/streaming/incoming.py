"""Newly arrived files, classified against the library as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def classify(batch: DataFrame, library: DataFrame, name: str = "fileName", digest: str = "sha256") -> DataFrame:
    """`batch` with `status` and `issue`: whether name or content is in the library already, or twice in the batch.

    Two look-ups of distinct names and digests, and counts within the batch; nothing is paired. Null names and
    digests match nothing.
    """
    names = library.where(F.col(name).isNotNull()).select(F.lower(name).alias("__n")).distinct().withColumn("__has_name", F.lit(True))
    digests = library.where(F.col(digest).isNotNull()).select(F.col(digest).alias("__d")).distinct().withColumn("__has_digest", F.lit(True))
    in_batch = lambda c, out: batch.where(c.isNotNull()).groupBy(c.alias(f"__{out}")).agg((F.count(F.lit(1)) > 1).alias(f"__twice_{out}"))
    j = (
        batch.join(names, F.lower(name) == F.col("__n"), "left").join(digests, F.col(digest) == F.col("__d"), "left")
        .join(in_batch(F.lower(name), "bn"), F.lower(name) == F.col("__bn"), "left").join(in_batch(F.col(digest), "bd"), F.col(digest) == F.col("__bd"), "left")
    )
    issues = F.array_compact(F.array(
        F.when(F.col("__has_digest"), F.lit("same content in library")), F.when(F.col("__has_name"), F.lit("same name in library")),
        F.when(F.col("__twice_bd"), F.lit("same content in batch")), F.when(F.col("__twice_bn"), F.lit("same name in batch")),
    ))
    return j.select(*batch.columns, F.when(F.size(issues) > 0, "check").otherwise("new").alias("status"), F.array_join(issues, " / ").alias("issue"))


def watch(arrivals: DataFrame, library_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Classify every micro-batch of a streaming table of files and append it to `out_path`; ends when all is read.

    The library is read anew for each batch. A batch that is retried replaces its own folder, so it is written once.
    """

    def each(batch: DataFrame, number: int) -> None:
        library = batch.sparkSession.read.parquet(library_path)
        classify(batch, library).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
