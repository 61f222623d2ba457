import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import check

FOLDER = "/root/testdata/sf0.001"
# SQL cannot say them (tests/llm compares those with brute force).
WITHOUT_SQL = {"pipeline", *(n for n in entry.queries() if n.startswith(("op3_", "op4_", "op5_", "op7_", "op9_", "op10_")))}


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", entry.queries())
def test_query_equals_its_sql(spark, connection, name):
    _, rows, verdict = check(spark, connection, FOLDER, name)
    assert verdict == ("no SQL" if name in WITHOUT_SQL else "equal")
    assert rows > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "text"]
    assert df.count() > 0
