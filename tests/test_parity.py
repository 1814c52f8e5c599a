"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from dosequant.checks.oracles import ORACLES
from dosequant.checks.registry import QUERIES, Inputs

DATA = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("part", "lineitem", "pages")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')"
        )
    return connection


def comparable(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, DATA)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = comparable(cursor.fetchall())
    found = comparable(tuple(row) for row in df.select(*columns).collect())
    assert found == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_one_representative_row_per_code_with_usage(spark):
    rows = Inputs(spark, DATA).relation("prescribing")
    codes = rows.where("ADQ_Usage > 0").select("BNF_Code").distinct()
    found = entry_points.queries()["representative_presentation"](spark, DATA)
    assert found.count() == codes.count()
    assert found.select("BNF_Code").distinct().exceptAll(codes).isEmpty()
    assert found.exceptAll(rows.select(*found.columns)).isEmpty()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.where("adq_per_quantity IS NOT NULL").count() > 0
