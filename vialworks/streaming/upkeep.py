"""Work that goes on from run to run: reading only what is new, keeping a queue, logs that only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unread(files: DataFrame, read: DataFrame, key: str, retry: str | None = None) -> DataFrame:
    """Files that weren't read, and with `retry`, a condition on `read`, those whose reading should be tried again."""
    done = read.where(f"not coalesce({retry}, false)") if retry else read
    return files.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def upsert_queue(queue: DataFrame, seen: DataFrame, key: str, kept: list[str], at: str) -> DataFrame:
    """The queue after a run: rows of `seen` with their columns anew and the `kept` columns of the queue, rows that are
    gone with state `missing`. lastSeen is `at` for what was seen, else what it was. Keys are unique on each side."""
    machine = [c for c in seen.columns if c not in (key, *kept)]
    old = queue.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in (*kept, *machine) if c in queue.columns], *([F.col("lastSeen").alias("__last")] if "lastSeen" in queue.columns else [F.lit(None).cast("string").alias("__last")]))
    new = seen.withColumn("__seen", F.lit(True))
    j = new.join(old, new[key] == old["__k"], "full_outer")
    has = F.col("__seen").isNotNull()
    past = lambda c: F.col(f"__{c}") if c in queue.columns else F.lit(None).cast(seen.schema[c].dataType if c in seen.columns else "string")
    return j.select(
        F.coalesce(F.col(key), F.col("__k")).alias(key), *[F.when(has, F.col(c)).otherwise(past(c)).alias(c) for c in machine], *[past(c).alias(c) for c in kept],
        F.when(has, "present").otherwise("missing").alias("state"), F.when(has, F.lit(at)).otherwise(F.col("__last")).alias("lastSeen"),
    )


def append_log(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of changes to a log; a restart goes on where it stopped, so no change is written twice."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
