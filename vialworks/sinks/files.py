"""Writing catalogue files: CSV that spreadsheets may safely open, JSON and CSV reports, releases published as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialworks.functions.text import csv_cell

BOM = "\ufeff"


def csv_line(*cells: Column) -> Column:
    """One CSV line without its end. A cell that could start a formula gets an apostrophe, then quotes where needed."""
    return F.concat_ws(",", *[csv_cell(c.cast("string")) for c in cells])


def csv_header(names: list[str]) -> str:
    return BOM + ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in '",\r\n') else n for n in names)


def write_csv(df: DataFrame, path: str, header: list[str] | None = None, files: int | None = None) -> None:
    """Every part is a CSV file of its own, with byte order mark and header, lines ended by CR LF, formulas defused.

    The header goes into each part by its tasks, so the rows are not brought together; `files` sets how many parts.
    """
    names = header or df.columns
    lines = df.select(csv_line(*[F.col(f"`{c}`") for c in df.columns]).alias("value"))
    lines = lines.repartition(files) if files else lines
    top = csv_header(names)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([top, *values] if first else values, pa.string())], names=["value"])
            first = False
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([top], pa.string())], names=["value"])

    lines.mapInArrow(with_header, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines and as CSV, side by side."""
    df.write.mode("overwrite").json(f"{path}/json")
    write_csv(df, f"{path}/csv")


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Writes all tables under a new version and then moves the pointer `current` to it, so a reader sees the old release
    or the new one as a whole, and a failure leaves the old one. Older versions stay as backups. Gives the version's path."""
    target = f"{root}/versions/{version}"
    some = next(iter(tables.values()))
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
    pointer = some.sparkSession.createDataFrame([(version,)], "version string")
    pointer.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return target


def current(spark, root: str) -> str:
    """The path of the version that the pointer names."""
    return f"{root}/versions/{spark.read.json(f'{root}/current').first().version}"
