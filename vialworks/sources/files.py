"""Reading catalogue files: JSON lists in several wrappings, file listings, mapped names, reviewed uploads, sheets as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of tools and archives that a listing skips.
SKIPPED = r"(^|/)(?:\.git|node_modules|__pycache__|_archive[^/]*|_backup[^/]*)(/|$)"


def read_json_list(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """The records of a JSON file that is an array, or an object that holds the array under `key`. A byte order mark is
    skipped. A missing file gives no row; a file that isn't JSON gives no row either, but is an error with `strict`
    readers such as `read_reviewed`."""
    item = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField(key, T.ArrayType(item))]) if key else T.ArrayType(item)
    try:
        texts = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    except AnalysisException:
        return spark.createDataFrame([], item)
    got = F.from_json("v", whole)
    return texts.select(F.explode(got.getField(key) if key else got).alias("x")).select("x.*")


def first_available(spark: SparkSession, paths: list[str], schema: T.StructType | str, key: str | None = None) -> tuple[str | None, DataFrame]:
    """(path, records) of the first file that can be read and isn't empty; (None, no rows) if there's none."""
    for path in paths:
        df = read_json_list(spark, path, schema, key)
        if not df.limit(1).isEmpty():
            return path, df
    return None, read_json_list(spark, paths[0], schema, key).limit(0)


def load_products(spark: SparkSession, local: str, public: str, sample: str, schema: T.StructType | str, is_local: bool) -> tuple[str, DataFrame]:
    """The catalogue: the local file, the public one, or the sample. Only in local mode does the sample stand in."""
    path, df = first_available(spark, [local, public] if is_local else [public], schema, "products")
    if path is None and not is_local:
        raise FileNotFoundError(f"{public} can't be read")
    return (path, df) if path else first_available(spark, [sample], schema, "products")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", digest: bool = True) -> DataFrame:
    """(relativePath, fileName, fileSize, modifiedTime, sha256) of all files below a folder that match, without those in
    folders of tools and archives. Contents are read only for their digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    # paths come as addresses, with or without an authority and with escaped letters
    relative = F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^.*?" + "\\Q" + folder.rstrip("/").removeprefix("file:") + "\\E/", "")
    out = files.select(relative.alias("relativePath"), F.element_at(F.split(relative, "/"), -1).alias("fileName"), F.col("length").alias("fileSize"), F.col("modificationTime").alias("modifiedTime"), *([F.sha2("content", 256).alias("sha256")] if digest else []))
    return out.where(~F.col("relativePath").rlike(SKIPPED))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(source, file) of a hand-made mapping, written as a list of objects or as one object."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    pair = T._parse_datatype_string("source string, id string, productName string, file string, fileName string")
    listed = texts.where(F.col("v").rlike(r"^\s*\[")).select(F.explode(F.from_json("v", T.ArrayType(pair))).alias("x")).select(F.coalesce("x.source", "x.id", "x.productName").alias("source"), F.coalesce("x.file", "x.fileName").alias("file"))
    mapped = texts.where(F.col("v").rlike(r"^\s*\{")).select(F.explode(F.from_json("v", T.MapType(T.StringType(), T.StringType()))).alias("source", "file"))
    return listed.unionByName(mapped).where("source is not null and file is not null")


def expand_renames(renames: DataFrame) -> DataFrame:
    """(old, new): every rename also without `pdf/` in front, and with a slash before it."""
    both = F.col("old").startswith("pdf/") & F.col("new").startswith("pdf/")
    forms = F.array_compact(F.array(F.struct("old", "new"), F.when(both, F.struct(F.substring("old", 5, 1 << 20).alias("old"), F.substring("new", 5, 1 << 20).alias("new"))), F.when(both, F.struct(F.concat(F.lit("/"), "old").alias("old"), F.concat(F.lit("/"), "new").alias("new")))))
    return renames.select(F.explode(forms).alias("x")).select("x.*").distinct()


def read_reviewed(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Records of a reviewed JSON-lines file with `problem`: what is wrong with a line, or null. No line is dropped."""
    fields = T._parse_datatype_string(schema)
    full = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required])), ", ")
    problem = F.when(F.col("_corrupt_record").isNotNull(), F.lit("not readable")).when(missing != "", F.concat(F.lit("missing: "), missing))
    return df.select(*[f.name for f in fields.fields], problem.alias("problem"))


def rows_to_entries(rows: DataFrame, order: str, identity: list[str]) -> DataFrame:
    """`rows` with `entry`, the number of the entry they belong to: a row with an identity begins one, one without goes on
    with the last above it; rows above the first have none. Spreadsheets are ordered as a whole, so this is one window;
    they hold at most some million rows."""
    starts = F.lit(False)
    for c in identity:
        starts = starts | (F.coalesce(F.trim(c), F.lit("")) != "")
    n = F.sum(starts.cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("entry", F.when(n > 0, n))
