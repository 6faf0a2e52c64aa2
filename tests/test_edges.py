"""Every query on empty tables and on tables with a row of nulls only."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tests.test_oracles import FOLDER, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        df, name = spark.read.parquet(f), os.path.basename(f)
        df.limit(0).write.parquet(f"{empty}/{name}")
        spark.range(1).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in df.schema]).write.parquet(f"{nulls}/{name}")
    return str(empty), str(nulls)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_ends_on_empty_tables_and_nulls(spark, folders, name):
    for folder in folders:
        assert QUERIES[name](spark, folder).count() >= 0
