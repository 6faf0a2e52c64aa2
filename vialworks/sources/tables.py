"""Parquet tables of a catalogue folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; the folder may hold a file or a directory of that name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
