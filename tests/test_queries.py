"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
EXPECTED = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", list(entry.invoice_queries()))
def test_query(spark, duck, name):
    frame = entry.invoice_queries()[name](spark, str(DATA))
    result = duck.execute(EXPECTED[name])
    names = [d[0] for d in result.description]
    columns = sorted(names)
    assert sorted(frame.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == expected


def test_few_bytes_of_much_work_are_spread(spark, tmp_path, monkeypatch):
    """Rows of one row group, of which texts are rendered, are worked on by all cores."""
    monkeypatch.setattr(entry, "SPREAD", None)
    spark.range(40).selectExpr("id c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("id o_orderkey", "id o_custkey", "1.5D o_totalprice", "date'1999-02-01' o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("many_anchors", "wide_gaps", "parse_date"):
        frame = entry.invoice_queries()[name](spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
